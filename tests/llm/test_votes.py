from pyspark.sql import functions as F

from lakewarden.llm import audio


def test_single_equal_codes_make_no_rows(spark):
    """30 recordings share single codes at any offset, which are no match; two share three votes at one offset, of which each offset's count is exact."""
    rows = [(k, [7 + 100 * k + i if i != k % 8 else 5 for i in range(10)], k % 10 == 0) for k in range(1, 31)]
    rows += [(100, [1, 2, 2, 3, 0, 4, 8, 8, 6, 9], True), (101, [50, 51, 1, 2, 60, 3, 0, 61, 62, 6], False), (102, [4, 52, 99, 1, 70, 71, 3, 72, 73, 74], False)]
    classes = spark.createDataFrame(rows, "class_id long, codes array<bigint>, _query boolean")
    seeds = {k: {i: c for i, c in enumerate(codes) if c and (i == 0 or codes[i - 1] != c)} for k, codes, _ in rows}

    def plain(least):
        count = {}
        for q, _, asked in rows:
            for d in seeds if asked else ():
                for i, c in seeds[q].items() if d != q else ():
                    for j in (j for j, x in seeds[d].items() if x == c):
                        count[q, d, j - i] = count.get((q, d, j - i), 0) + 1
        return {k: n for k, n in count.items() if n >= least}

    for least in (1, 2, 3):
        assert {(r.id, r.class_id, r.offset): r.votes for r in audio.votes_of(classes, least).collect()} == plain(least)
    assert len(plain(1)) > 80 and plain(2) == {(100, 102, 3): 2, (100, 101, 2): 3}
    few = audio.vote_pairs(classes.filter("class_id <= 30")).groupBy("both", "gap").agg(F.count("*").alias("n"))
    assert few.filter("n > 1").count() == 0
