import hashlib
import re
import unicodedata

import pytest

pytest.importorskip("millrace.llm.mixing")

import xxhash  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import fingerprint, line_dedup, mixing  # noqa: E402
from millrace.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, row int, `hash` string, pos int, h int, key int"
EXTRA = ("x", 1, "y", 2, 3, 4)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_mixing", "op5_topk"])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    for t in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = q.QUERIES[name](spark, SF)
    want = duckdb.sql(q.ORACLES[name])
    got = out.select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_line_cases(spark):
    rows = [(i, f"own {i}\nmenu \n\nmenu", f"s{i % 6}") for i in range(12)]
    rows += [(20, None, "s0"), (21, "", None), (None, "menu", None), (3, rows[3][1], "s3"), (30, "a " * 50_000 + "\nmenu", "s1")]
    docs = frame(spark, rows)
    got = {(r.row.doc_id, r.clean, r.n_removed) for r in line_dedup.line_dedup(docs).collect()}
    assert (0, "own 0\nmenu \n", 1) in got  # the first place stays
    assert {(1, "own 1\n", 2), (20, None, 0), (21, "", 0), (None, "", 1), (3, "own 3\n", 2), (30, "a " * 50_000, 1)} <= got
    kept = line_dedup.deduped(docs)
    assert kept.columns == docs.columns
    assert None not in {r.doc_id for r in kept.collect()}  # nothing of it was left
    assert kept.filter("doc_id = 3").count() == 2
    assert line_dedup.deduped(docs.limit(0)).count() == 0
    few = frame(spark, [(i, "menu", f"s{i}") for i in range(4)])
    assert line_dedup.deduped(few).count() == 4  # four sources are not enough


def test_spread_near_and_far_from_the_threshold(spark):
    rows = [(1000 * s + i, f"line {s}", f"site{i}") for s in range(1, 60) for i in range(s)]
    lines = line_dedup._lines(line_dedup._packed(frame(spark, rows)))
    for least in (5, 20, 40):
        assert line_dedup.boilerplate(lines, least).count() == 60 - least


def test_mixing_cases(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(500, None, "big"), (501, "", "empty"), (None, "a b c", None), (7, rows[7][1], "s9"), (600, "w " * 40_000, "long")]
    docs = frame(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    targets = {r.source: (r.source_size, r.target) for r in out}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(s for s, _ in targets.values()))
    assert all(t <= 2 * s for s, t in targets.values())
    assert targets["empty"] == (0, 0.0)
    for s, (size, target) in targets.items():
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own), (s, size)
    again = {(r.row.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.row.doc_id, r.taken) for r in out}
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert copies.filter("doc_id IN (500, 501)").count() == 2
    assert mixing.mixed(docs.limit(0)).count() == 0


def plain_form(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).casefold()).strip(" ")


def plain_fingerprint(text):
    form = plain_form(text).encode()
    h1 = xxhash.xxh64_intdigest(form, 42)
    return h1, form


def brute_fingerprints(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), t, edit, after))
    return out


def check_fingerprints(got, rows):
    want, prints = [], {}
    for d, n, sha, text, edit, after in brute_fingerprints(rows):
        want.append((str(d), n, sha, f"{plain_fingerprint(text)[0]:016x}", float(plain_form(text) == plain_form(edit)), float(plain_form(text) == plain_form(after))))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint[:16], r.near_edited, r.near_next) for r in got) == sorted(want)
    for d, text in rows:
        prints.setdefault(plain_form(text or ""), set()).update(r.fingerprint for r in got if r.doc_id == d and r.fingerprint[:16] == f"{plain_fingerprint(text or '')[0]:016x}")
    assert all(len(x) == 1 for x in prints.values())


def test_fingerprint_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_fingerprints(fingerprint.query(spark, SF).collect(), rows)


def _query(docs):
    out = fingerprint.fingerprints(docs)
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.withColumns({"near_edited": alike("edited_fingerprint"), "near_next": alike("next_fingerprint")})


def test_fingerprint_cases(spark):
    rows = [(1, "Straße  ﬁń"), (2, "STRASSE fiń"), (3, None), (4, ""), (9, "x"), (9, "x"), (7, "漢字🙂 " * 20_000), (None, "last"), (12, "a  b"), (13, "A b")]
    rows += [(100 + i, f"doc {i % 5} ") for i in range(40)]
    docs = frame(spark, [(*r, "s") for r in rows])
    check_fingerprints(_query(docs).collect(), rows)
    check_fingerprints(_query(docs.limit(1)).collect(), rows[:1])
    assert _query(docs.limit(0)).count() == 0


def test_fingerprints_of_equal_values_are_compared(spark, monkeypatch):
    weak = lambda form: F.struct((F.length(form) % 3).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"))
    monkeypatch.setattr(fingerprint, "wide_hash", weak)
    rows = [(i, t) for i, t in enumerate(["a", "b", "A", "dddd", "cc", "", None, "  b "])]
    got = _query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = {}
    for r in got:
        names.setdefault(plain_form(dict(rows)[r.doc_id] or ""), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in names.values())
    assert len(set.union(*names.values())) == len(names)
