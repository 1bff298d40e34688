from collections import Counter, defaultdict

import duckdb
import numpy as np

from lodestone.llm import line_dedup


def rows(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def brute(pairs, most):
    clean = lambda s: " ".join(s.replace("\t", " ").replace("\r", " ").split(" ")).strip().lower()
    squeeze = lambda s: " ".join(x for x in clean(s).split(" ") if x)
    seen = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if squeeze(line):
                seen[squeeze(line)].add(i if i is not None else ("text", t))
    out = []
    for i, t in pairs:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = [x for x in lines if len(seen[squeeze(x)]) <= most]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_against_brute_force(docs_of):
    rng = np.random.default_rng(1)
    lines = [f"Line  number\t{k}" for k in range(30)] + ["", "  "]
    pairs = [(k, "\n".join(rng.choice(lines, rng.integers(1, 12)))) for k in range(60)]
    pairs += [(k, t.upper()) for k, t in pairs[:5]] + [(None, "Line number 1"), (None, "Line number 1"), (99, None), (98, "")]
    for most in (1, 5, 15):
        assert rows(line_dedup.drop_common_lines(docs_of(pairs), most=most)) == brute(pairs, most)


def test_odd_and_empty(odd, empty):
    got = line_dedup.drop_common_lines(odd, most=1)
    assert got.count() == odd.count() and got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert by[1].text is None and by[1].n_lines == 0
    assert by[2].text == "" and by[3].n_dropped == 0
    assert by[4].text == "" and by[4].n_dropped == 4000
    assert by[6].text == "" and by[7].n_dropped == 1  # of two documents, though in three rows
    assert line_dedup.drop_common_lines(odd, most=2).where("doc_id = 6 AND n_dropped = 0").count() == 2
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_the_sql_says_the_same(spark, docs_of, tmp_path):
    rng = np.random.default_rng(2)
    lines = [f"shared {k}" for k in range(8)] + [f"own {k}" for k in range(300)]
    frame = docs_of([(k, "\n".join(rng.choice(lines, 20))) for k in range(80)])
    documents = frame.toPandas()  # noqa: F841
    want = duckdb.sql(line_dedup.SQL).fetchall()
    assert rows(line_dedup.drop_common_lines(frame)) == sorted(want, key=repr)
    assert counter(want) > 0


def counter(rows):
    return Counter(n > 0 for *_, n in rows)[True]
