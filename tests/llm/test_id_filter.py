"""The bitmap in front of exact joins changes no row."""

from tidefeed.llm import id_filter as I


def test_asked_and_without(spark, monkeypatch):
    rows = spark.createDataFrame([(n if n % 7 else None, f"t{n}", n, "x") for n in range(300)], "doc_id long, text string, bits int, n string")
    ids = spark.createDataFrame([(n,) for n in range(0, 300, 3)] + [(10**12,)], "gone long")
    for bits in (1 << 26, 64, 1):
        monkeypatch.setattr(I, "BITS", bits)
        got = sorted(r["bits"] for r in I.asked(rows, "doc_id", ids).collect())
        left = I.without(rows, "doc_id", ids)
        assert got == [n for n in range(300) if n % 7 and n % 3 == 0] and left.columns == rows.columns
        assert sorted(r["bits"] for r in left.collect()) == [n for n in range(300) if not n % 7 or n % 3]
    empty = ids.limit(0)
    assert I.asked(rows, "doc_id", empty).count() == 0 and I.without(rows, "doc_id", empty).count() == 300
    assert I.without(rows.limit(0), "doc_id", ids).count() == 0
