from rasterloom.operators import measurement as m

TEXT = """# Results

## arm64 (a chip)

Encode, quality 90
```
file mode engine width height bytes psnr_db iters ms_per_op
a-1.jpg lossy libwebp 10 20 1000 41.5 3 12.5
a-1.jpg lossless ours 10 20 900 - 3 30.0
```

Peak RSS
```
a-1.jpg lossy libwebp 10 20 1000 5 18.5
ours,lossy,lossb.jpg,10,20,1000,5,19.5
```

Decode
```
a-1.jpg lossy libwebp 10 20 1000 5 2.25
```
stray a-1.jpg lossy libwebp 10 20 1000 41.5 3 12.5
## amd64
Effort sweep
```
a-1.jpg,lossy,ours,4,10,20,800,40.0,3,9.5
ours,lossy,5,a-1.jpg,10,20,700,-,3,19.5
bad row
```
"""


def test_result_files(spark):
    lines = spark.createDataFrame([("r.md", i, x) for i, x in enumerate(TEXT.split("\n"))], "path string, n long, line string")
    got = [(r.heading, r.engine, r["mode"], r.file, r.effort, r.bytes, r.psnr, r.ms, r.mib_per_mp) for r in m.parsed(lines).orderBy("n").collect()]
    assert got == [
        ("arm64 (a chip)", "libwebp", "lossy", "a-1.jpg", None, 1000, 41.5, 12.5, None),
        ("arm64 (a chip)", "ours", "lossless", "a-1.jpg", None, 900, None, 30.0, None),
        ("arm64 (a chip)", "libwebp", "lossy", "a-1.jpg", None, None, None, None, 18.5),
        ("arm64 (a chip)", "ours", "lossy", "lossb.jpg", None, None, None, None, 19.5),
        ("arm64 (a chip)", "libwebp", "decode-lossy", "a-1.jpg", None, None, None, 2.25, None),
        ("amd64", "ours", "sweep-lossy", "a-1.jpg", 4, 800, 40.0, 9.5, None),
        ("amd64", "ours", "sweep-lossy", "a-1.jpg", 5, 700, None, 19.5, None),
    ]
