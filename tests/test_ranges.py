"""Range questions over whole documents, against brute force."""

import pytest

from folioflow.plans.queries import QUERIES

SIZES = [(1, 9000), (2, 30), (3, None), (4, 6953)]


def made(doc, n, width, step, shift):
    return [(k * step + shift + (doc + k) % 7, (doc + k) % (width + 1), k) for k in range(max(0, (n or 0) // step - 1) + 1)]


def brute(name):
    out = []
    for doc, n in SIZES:
        blocks, selections, markers = made(doc, n, 30, 40, 0), made(doc, n, 12, 170, 20), made(doc, n, 4, 23, 3)
        over = lambda r, o: r[0] < o[0] + o[1] and o[0] < r[0] + r[1]
        active = [b for b in blocks if any(b[0] <= s[0] + s[1] and s[0] <= b[0] + b[1] for s in selections)]
        shown = lambda m: ("hidden", "bullet", "hidden", "checkbox")[m[2] % 4]
        out += {
            "active_blocks": lambda: [(doc, *b[:2]) for b in active],
            "visible_blocks": lambda: [(doc, *b[:2]) for b in blocks if any(over(b, s) for s in selections)],
            "concealed_markers": lambda: [(doc, *m[:2], shown(m)) for m in markers if shown(m) == "hidden" and not any(over(m, a) or a[0] <= m[0] < a[0] + a[1] for a in active)],
            "painted_markers": lambda: [(doc, *m[:2], shown(m)) for m in markers if shown(m) != "hidden" and not any(over(m, a) for a in active)],
            "points_in_blocks": lambda: [(doc, m[0], *b[:2]) for m in markers for b in blocks if b[0] <= m[0] < b[0] + b[1]],
        }[name]()
    return sorted(out)


@pytest.mark.parametrize("name", ["active_blocks", "visible_blocks", "concealed_markers", "painted_markers", "points_in_blocks"])
def test_ranges_go_to_the_end_of_a_document(spark, tmp_path, name):
    spark.createDataFrame(SIZES, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == brute(name)
