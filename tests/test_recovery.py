"""Sequence recovery as it is counted letter by letter, without a row for each letter."""

from strandframe.operators import scoring as S


def test_recovery_counts_as_letter_by_letter(spark):
    rows = [
        (1, "ACDX", "ACEX", [1, 1, 1, 1]), (2, "AÉß\U0001F600C", "AÉs\U0001F600C", [1, 0, None, 2]), (3, "ACD", "A", [1]), (4, "", "A", []), (5, "XX", "XX", None),
        (6, "ACD", None, [1, 1, 1]), (7, None, "A", [1]), (8, "AC", "ACDE", [0, 1, 1, 1]), (9, "ÉA", "EA", [1, 1]), (9, "AA", "AC", [1, 1]),
    ]
    df = spark.createDataFrame(rows, "id int, native string, sequence string, mask array<int>")

    def by_letter(masked):
        counts = {}
        for i, a, b, m in rows:
            if a is not None:
                own = [k for k, c in enumerate(a) if c != "X" and (not masked or (m is not None and k < len(m) and m[k]))]
                same, n = counts.get(i, (0, 0))
                counts[i] = same + sum(b is not None and k < len(b) and b[k] == a[k] for k in own), n + len(own)
        return {i: same / n if n else None for i, (same, n) in counts.items()}

    for mask in (None, "mask"):
        found = S.seq_recovery(df, ["id"], mask)
        assert {r["id"]: r["recovery"] for r in found.collect()} == by_letter(mask)
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
