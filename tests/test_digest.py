"""Digests of documents: lines in order of position, made without a lambda for each row."""
import hashlib

from tagflow.plans import catalog


def test_digests_are_of_the_lines_in_order(spark):
    rows = [(d, p, f"w{p}", "O" if p % 3 else "B-ORG") for d, n in ((1, 1), (2, 30)) for p in range(n)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, pos int, tok string, tag string").repartition(3)
    want = {d: (n, hashlib.md5("\n".join(f"{t} {g}" for x, _, t, g in rows if x == d).encode()).hexdigest()) for d, n in ((1, 1), (2, 30))}
    for got in (catalog.tag_digest(df), catalog.line_digest(df, "m", "tok", "tag")):
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
        assert "lambda" not in got._jdf.queryExecution().toString()
