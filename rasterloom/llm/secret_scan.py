"""Secret scans: base patterns, and multipart credential linking by an interval join within a text's scopes.

A credential's parts are identifiers (access keys, account names, addresses), secrets (assigned values, hexadecimal strings,
long mixed tokens) and endpoints (URLs, host names, network addresses). The base patterns are reported wherever they stand.
Weak parts (ident, blob, endpoint) are reported only where complementary ones co-occur: a secret with an identifier or an
endpoint that is other text, in one scope. Two parts share a scope if they lie in one section, the lines up to a blank one, that is no
longer than SECTION code points, as settings are written; or, in prose, if no more than REACH code points lie between them. A weak part
that overlaps a base span is that span's and isn't reported.

The interval join is a sweep inside each row: ends and starts of parts, section bounds and the weak parts' own edges are sorted, and
running extremes tell, for each weak part, the nearest complementary part and section bound on either side. No pairs are made, nothing
is shuffled, and a text with n matches costs n to the power of 1.5 array copies at most.

Cases: a null text counts as an empty one; a very long text is one row's work; repeated rows each get the same spans; an empty table gives
an empty result; spans of one start are in order of their kinds; positions are code points, ends exclusive; further columns are left out
unless named in keep, and redact() keeps all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import let, match_starts, running

REACH, SECTION = 200, 2000
#: What parts sections.
BLANK_LINES = "\\n[ \\t\\x0B\\x0C\\r]*\\n"


def _any_case(*names: str) -> str:
    return "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in names) + ")"


ASSIGN = _any_case("password", "passwd", "secret", "token", "api_?key") + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Mail addresses, whose parts are as long as the format allows (64 and 63), and named accounts.
IDENT = (
    "(?:[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63})+|"
    + _any_case("user", "username", "login", "account", "client_id", "key_id")
    + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,})"
)
BLOB = "[A-Za-z0-9+/_-]{20,}"
ENDPOINT = "(?:[a-z]{2,12}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}|[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}(?::[0-9]{1,5})?)"
#: Names in the order in which spans of one start are listed, and the roles of their kinds.
KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
SECRET, ALLIES = (0, 2, 4), (1, 3, 5)
SPANS = "array<struct<s:int,k:int,e:int>>"
_NONE = f"cast(array() as {SPANS})"
#: Below all places.
_LOW = -(1 << 30)


def _spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """Spans (start, kind, end) of a pattern's matches for which good holds."""
    found = match_starts(text, pattern)
    found = F.filter(found, lambda x: good(x["m"])) if good is not None else found
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), (x["s"] + F.length(x["m"])).alias("e")))


def _long_value(m: Column) -> Column:
    """assign's matches hold if the value, group 1 here, has six characters."""
    return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6


def _mixed(m: Column) -> Column:
    """blobs hold if they have digits as well as letters."""
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


def parts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the text, its base spans, its weak parts and the places of its section bounds. One narrow pass.

    Weak parts are sought only in texts that have a base span or both an ally and a digit, which costs little where there is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ins = [f"_in_{c}" for c in keep]
    some = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ins, strict=True)], text.alias("text"))
    t, none = F.col("text"), F.expr(_NONE)
    access = F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(none)
    # an assignment has one of its signs, and looking for these is cheap
    assign = F.when(t.contains("=") | t.contains(":"), _spans(t, ASSIGN, 0, _long_value)).otherwise(none)
    base = F.concat(assign, access, _spans(t, HEX, 2))
    some = some.select(*ins, "text", F.sort_array(base).alias("base"))
    some = some.select(*ins, "text", "base", ((F.size("base") > 0) | (t.rlike("[0-9]") & (t.rlike(IDENT) | t.rlike(ENDPOINT)))).alias("maybe"))
    weak = F.sort_array(F.concat(_spans(t, IDENT, 3), _spans(t, BLOB, 4, _mixed), _spans(t, ENDPOINT, 5)))
    bounds = F.when(F.col("maybe"), F.transform(match_starts(t, BLANK_LINES), lambda x: x["s"])).otherwise(F.expr("cast(array() as array<int>)"))
    return some.select(*[F.col(i).alias(c) for c, i in zip(keep, ins, strict=True)], "text", "base", F.when(F.col("maybe"), weak).otherwise(none).alias("weak"), bounds.alias("bounds"))


def _event(p: Column, order: int, i: Column | int = -1, **values: Column) -> Column:
    """Something at place p; of one place, lower orders come first. i numbers what asks; others give values."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(p.alias("p"), F.lit(order).alias("o"), lit(i).alias("i"), *[lit(values.get(n, _LOW)).alias(n) for n in "abc"])


def _greatest_before(events: Column) -> Column:
    """For each event that asks, by its number, the greatest values (a, b, c) of the events before it."""
    up = lambda x, y: F.struct(*[F.greatest(x[n], y[n]).alias(n) for n in "abc"])
    low = F.struct(*[F.lit(_LOW).alias(n) for n in "abc"])

    def of(ordered: Column) -> Column:
        tops = running(F.transform(ordered, lambda x: F.struct(*[x[n].alias(n) for n in "abc"])), low, up)
        return F.sort_array(F.filter(F.zip_with(ordered, tops, lambda x, v: F.struct(x["i"].alias("i"), v.alias("v"))), lambda x: x["i"] >= 0))

    return let(F.sort_array(events), of)


def _links(base: Column, weak: Column, bounds: Column, end: Column, reach: int, section: int) -> Column:
    """The weak parts that have a complementary one in scope and overlap no base span."""
    secret = lambda x: x["k"].isin(*SECRET)
    low = F.lit(_LOW)

    def sweep(w: Column) -> Column:
        every = F.concat(base, w)
        # a, b: ends of secrets and of allies; c: bounds. Parts that end where another begins are before it.
        ahead = F.concat(
            F.transform(every, lambda x: _event(x["e"], 0, a=F.when(secret(x), x["e"]).otherwise(low), b=F.when(secret(x), low).otherwise(x["e"]))),
            F.transform(bounds, lambda p: _event(p, 0, c=p)),
            F.transform(w, lambda x, i: _event(x["s"], 1, i)),
        )
        # the same from the text's end, by negative places
        behind = F.concat(
            F.transform(every, lambda x: _event(-x["s"], 0, a=F.when(secret(x), -x["s"]).otherwise(low), b=F.when(secret(x), low).otherwise(-x["s"]))),
            F.transform(bounds, lambda p: _event(-p, 0, c=-p)),
            F.transform(w, lambda x, i: _event(-x["e"], 1, i)),
        )
        over = F.concat(F.transform(base, lambda x: _event(x["s"], 1, a=x["e"])), F.transform(w, lambda x, i: _event(x["e"], 0, i)))
        before, after, cover = (_greatest_before(e) for e in (ahead, behind, over))
        told = F.zip_with(F.zip_with(w, before, lambda x, f: F.struct(x.alias("x"), f["v"].alias("f"))), F.zip_with(after, cover, lambda g, h: F.struct(g["v"].alias("g"), h["v"]["a"].alias("h"))), lambda l, r: F.struct(l["x"].alias("x"), l["f"].alias("f"), r["g"].alias("g"), r["h"].alias("h")))  # noqa: E741
        return F.transform(F.filter(told, holds), lambda y: y["x"])

    def holds(y: Column) -> Column:
        x, f, g = y["x"], y["f"], y["g"]
        back = F.when(secret(x), f["b"]).otherwise(f["a"])  # the complementary part's end, and from the text's end its start
        on = F.when(secret(x), g["b"]).otherwise(g["a"])
        whole = F.least(-g["c"], end) - F.greatest(f["c"], F.lit(0)) <= section
        near = (back + reach >= x["s"]) | (on + reach >= -x["e"])
        return (y["h"] <= x["s"]) & (near | (whole & ((back > f["c"]) | (on > g["c"]))))

    return F.when((F.size(weak) > 0) & (F.size(base) + F.size(weak) > 1), let(weak, sweep)).otherwise(F.expr(_NONE))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), reach: int = REACH, section: int = SECTION) -> DataFrame:
    """keep, the text's base spans and all of its spans, each (s, k, e), in order."""
    found = parts(docs, keep)
    links = _links(F.col("base"), F.col("weak"), F.col("bounds"), F.length("text"), reach, section)
    return found.select(*keep, "base", F.sort_array(F.concat("base", links)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mark; n_chars, if there, follows the text."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), "text")
    found = scan(whole, ("_doc",))

    def cut(spans: Column) -> Column:
        # four bytes a code point, so that a piece is found without going through what stands before it
        wide = F.encode(F.make_valid_utf8(F.col("_doc")["text"].cast("string")), "UTF-32")

        def pieces(ends: Column, raw: Column) -> Column:
            gaps = F.transform(spans, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("a"), x["s"].alias("b"), (i == 0).alias("first")))
            kept = F.concat(F.filter(gaps, lambda g: g["first"] | (g["b"] > g["a"])), F.array(F.struct(F.element_at(ends, -1).alias("a"), (F.length(raw) / 4).cast("int").alias("b"), F.lit(False).alias("first"))))
            return F.array_join(F.transform(kept, lambda g: F.decode(F.substring(raw, g["a"] * 4 + 1, (g["b"] - g["a"]) * 4), "UTF-32")), mark)

        return let(wide, lambda raw: let(running(F.transform(spans, lambda x: x["e"]), F.lit(0), F.greatest), lambda ends: pieces(ends, raw)))

    hit = F.size("spans") > 0
    out = found.select("_doc", F.when(hit, let(F.col("spans"), cut)).otherwise(F.col("_doc")["text"]).alias("_text"), hit.alias("_hit"))
    columns = {c: F.col("_doc")[c] for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_hit"), F.length("_text")).otherwise(F.col("_doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in columns.items()])
