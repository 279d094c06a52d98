import random

from rasterloom.operators import animation


def test_canvases_by_brute_force(spark):
    """Rectangles that reach over the canvas, empty ones, cleared ones, unknown values and wishes."""
    r, width, height = random.Random(4), 6, 5
    rows = [
        (anim, k, r.randrange(-2, 7), r.randrange(-2, 6), r.randrange(0, 6), r.randrange(0, 6), r.choice([None, *range(9)]), r.choice([True, False, None]))
        for anim in range(6)
        for k in range(r.randrange(1, 12))
    ]
    want = set()
    for anim in range(6):
        canvas, clear = {(x, y): 7 for x in range(width) for y in range(height)}, []
        for _, k, x0, y0, w, h, v, dispose in sorted(row for row in rows if row[0] == anim):
            inside = [p for p in canvas if x0 <= p[0] < x0 + w and y0 <= p[1] < y0 + h]
            canvas |= dict.fromkeys(clear, 7) | dict.fromkeys(inside, v)
            clear = inside if dispose else []
            want |= {(anim, k, x, y, c) for (x, y), c in canvas.items()}
    frames = spark.createDataFrame(rows, "anim long, k long, x0 long, y0 long, w long, h long, v long, dispose boolean")
    got = [tuple(x) for x in animation.composited(frames, width, height, 7).select("anim", "k", "x", "y", "v").collect()]
    assert len(got) == len(want) and set(got) == want
    assert animation.composited(frames.limit(0), width, height).count() == 0
