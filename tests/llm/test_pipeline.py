"""The pipeline's stages against brute force, one after the other on the same small documents."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_exact import BYTES, DOCS, base_counts, brute_marks, corpus, keyed_rows, shingles, union_find

import corpus_pipeline
from strandlake.llm import line_dedup, packing, quality, substring_dedup, tokenizer

PROSE = "the of and to in a is that for it was with be by on not he at are this have from or had an they which you were all there".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose that passes the rules: the corpus with function words mixed in, and its odd rows."""
    rows = []
    for i, (doc, text, *rest) in enumerate(corpus(9, 120)):
        if text and doc < 1000:
            words = text.split(" ")
            text = " ".join(w + " " + PROSE[(k * 7 + len(w)) % len(PROSE)] for k, w in enumerate(words))
        rows.append((doc, text, *rest[:2], len(text or "")))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def cleaned(docs, segment, removed):
    """Documents after the removal that removed(raw, later places) names as byte spans, by one table of all chunks."""
    later = brute_marks(keyed_rows(docs), segment)
    out = []
    for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).collect():
        text, n = r.text, r.n_chars
        places = later[r.h & 0xFFFFFFFFFFFFFFFF]
        new = removed((text or "").encode(), places) if places else None
        if new is not None:
            text, n = new, len(new)
            if not text.strip():
                continue
        out.append((r.doc_id, text, r.lang, r.source, n))
    return sorted(out, key=str)


def without_lines(raw, places):
    _, _, place, start, end = line_dedup.chunk_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    keep, upto = b"", 0
    for p, a, b in zip(place.tolist(), start.tolist(), end.tolist(), strict=True):
        if p in places:
            keep, upto = keep + raw[upto:a], min(b + 1, len(raw))
    if not upto:
        return None
    keep += raw[upto:]
    return (keep[:-1] if upto == len(raw) and keep.endswith(b"\n") else keep).decode()


def beside_repeated_chunks(docs):
    """The segment function of line dedup: lines by pairs, where chunks beside them stand twice, by one table of all chunks."""
    places = collections.defaultdict(set)
    for i, (_, text) in enumerate(docs.select("doc_id", "text").distinct().collect()):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        digest, _, place = line_dedup.chunks(raw, np.array([0, len(raw)]))
        for d, p in zip(digest.view(np.int64).tolist(), place.tolist(), strict=True):
            places[d].add((i, p))
    twice = np.array([d for d, at in places.items() if len(at) > 1], np.int64)

    def segment(data, offsets):
        allowed = set(zip(*[x.tolist() for x in line_dedup.candidate_pairs(data, offsets, lambda h: np.isin(h, twice))[1:3]], strict=True))
        digest, text, place = line_dedup.segment(data, offsets)
        keep = [(t, p - k % 2) in allowed for k, (t, p) in enumerate(zip(text.tolist(), place.tolist(), strict=True))]
        return digest[keep], text[keep], place[keep]

    return segment


def without_spans(raw, places):
    spans = substring_dedup.removed_spans(np.frombuffer(raw, np.uint8), places)
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode() if spans else None


def test_stages_one_by_one(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def step(name, df, n):
        path = f"{folder}/{n}"
        stages[name](spark, df, folder).write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "best-fit packing" or out.columns == docs.columns
        return out

    good = step("quality rules", docs, 1)
    judged, q = quality.judge(docs)
    assert rows_of(good) == rows_of(judged.where(F.col(q)["kept"]).select(docs.columns))
    assert {r.doc_id for r in good.collect()} <= {r.doc_id for r in docs.collect() if base_counts(r.text)[0] >= 20}
    assert 20 < good.count() < docs.count()

    lines = step("line dedup", good, 2)
    assert rows_of(lines) == cleaned(good, beside_repeated_chunks(good), without_lines)

    near = step("n-gram Jaccard join", lines, 3)
    sets = {r.doc_id: shingles(r.text) for r in lines.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(sets, links)
    assert rows_of(near) == sorted({tuple(r) for r in lines.collect() if root[r.doc_id] == r.doc_id}, key=str)
    assert near.count() < lines.count()

    passages = step("substring dedup", near, 4)
    assert rows_of(passages) == cleaned(near, substring_dedup.segment, without_spans)

    packed = step("best-fit packing", passages, 5).collect()
    coded = {r.doc_id: np.frombuffer(tokenizer.id_bytes(BYTES)([r.text or ""])[0], "<u4").tolist() + [packing.END] for r in passages.collect()}
    want = collections.Counter((d, p, n, zlib.crc32(np.array(coded[d][s : s + n], "<u4").tobytes())) for d in [r.doc_id for r in passages.collect()] for p, (s, n) in enumerate(packing.cut(len(coded[d]))))
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == want
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY

    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_one_row_of_a_group_stays(spark):
    """One id on several rows, equal or not, near copies of a smaller id, null ids and rows without words."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a.replace("w59", "x"), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, near, "en", "s", 1), (2, a, "en", "s", 1), (2, other, "en", "s", 1), (3, near, "en", "t", 1), (None, other, "en", "s", 1), (None, "only here", "en", "s", 1), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, None, "en", "s", 0)]
    got = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, spark.createDataFrame(rows, DOCS), "").collect()
    kept = collections.Counter(r.text for r in got)
    assert kept["only here"] == kept[""] == kept[None] == kept[other] == 1 and kept[a] + kept[near] == 1 and len(got) == 5
    assert {r.doc_id for r in got if r.text in (a, near)} == {1}


def test_scratch_tables_go(spark):
    import os

    from strandlake.llm.common import materialise, scratch

    with scratch(spark):
        table = materialise(spark.range(3), "x")
        folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        assert os.path.isdir(folder) and table.count() == 3
    assert not os.path.exists(folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_documents(spark, name):
    none = spark.createDataFrame([], DOCS)
    assert dict(corpus_pipeline.STAGES)[name](spark, none, "").count() == 0
