import hashlib

import pytest

from folioflow.llm import line_spread

BOILER = "Click here to subscribe"
ROWS = (
    [(i, f"{BOILER} \nown line {i}\n\n  only {i % 3}", f"s{i % 14}", "x", 1) for i in range(42)]
    + [(100, BOILER, None, "x", 1), (101, None, "s1", "x", 1), (102, "", "s2", "x", 1), (103, f"a\r\n{BOILER}\r\nb", "s3", "x", 1)]
    + [(200, "nine sites", f"s{i}", "x", 1) for i in range(9)]
    + [(300 + i, "ten sites\nkeep", f"s{i}", "x", 1) for i in range(10)]
    + [(400 + i % 2, "same site\n" * 50, "s0", "x", 1) for i in range(20)]
)
SCHEMA = "doc_id long, text string, source string, __other string, line int"


def brute(rows, min_sites):
    strip = lambda x: x.strip(" \t\r")
    sites = {}
    for _, text, site, *_ in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(strip(line), set()).add(site or "")
    spread = {k for k, v in sites.items() if k and len(v) >= min_sites}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = None if text is None else "\n".join(x for x in lines if strip(x) not in spread)
        out.append((doc_id, sum(strip(x) != "" for x in lines), sum(strip(x) in spread for x in lines), None if kept is None else len(kept), None if kept is None else hashlib.md5(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [10, 3])
def test_matches_exact_counts(spark, min_sites):
    got = line_spread.line_digest(spark.createDataFrame(ROWS, SCHEMA), min_sites)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_sites)


def test_empty_table_and_other_columns(spark):
    assert line_spread.line_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    out = line_spread.remove_spread_lines(spark.createDataFrame(ROWS, SCHEMA))
    assert out.columns[:5] == ["doc_id", "text", "source", "__other", "line"] and out.count() == len(ROWS)


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in ROWS])
    assert sorted(con.execute(line_spread.SQL).fetchall(), key=str) == brute(ROWS, 10)


@pytest.mark.parametrize("most", [200_000, 0])
def test_copies_of_a_text_need_not_count(spark, monkeypatch, most):
    """In the pipeline a text copied over many sites stays; a line shared by other texts still goes, and so it does from copies."""
    import corpus_pipeline

    monkeypatch.setattr(line_spread, "BROADCAST_COPIES", most)
    copies = [(i, f"copied line\nand another\n{BOILER}", "en", f"s{i}", 50) for i in range(25)]
    others = [(100 + i, f"{BOILER}\nown line {i}", "en", f"s{i}", 30) for i in range(10)] + [(200, None, "en", "s1", 0), (201, "", "en", None, 0)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert len(got) == 37 and {got[i].text for i in range(25)} == {"copied line\nand another"}
    assert [got[100 + i].text for i in range(10)] == [f"own line {i}" for i in range(10)]
    assert got[200].text is None and got[201].text == "" and all(got[i].source == f"s{i}" for i in range(25))
