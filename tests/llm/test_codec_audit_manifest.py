"""Merge codec, filter audit and manifest against the library, brute force and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import bpe_codec, filter_audit, manifest, tokenizer
from tests.llm.test_exact import DOCS, WORD, corpus

WORDS = tokenizer.default_path("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"


def write(spark, tmp_path, rows, labels=()):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder


def odd_rows():
    """Null ids, langs and sizes, copies under one and several ids, repeated rows, a lone row of a lang."""
    rows = [r if i % 3 else (*r[:2], "de", *r[3:]) for i, r in enumerate(corpus())]
    return [*rows, (None, "no id", "en", "s", 3), (None, "no id", "en", "s", 3), (None, None, None, None, None), (7, "lone", "zz", "", 0), (8, "", "", "", None), (500, rows[3][1], "en", "s0", 9), (2, rows[3][1], "de", "s1", 9)]


# --- merge codec ---------------------------------------------------------------------------------------------------


def strings(seed=5, n=600):
    rng = random.Random(seed)
    odd = ["", "   ", "a" * 3000, "ab" * 900, "the" * 400, "x<|endoftext|>y<|startoftext|>", "<|endoftext|>", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ŉ", "e<|endoftext|>́", "🙂👍🏽", "don't DON'T we'Ll 'sss", "12 ١٢٣ ½", " 　x\x1c\x1d\x85y​", "\0a\x01", "՘\U00010940"]
    for _ in range(n):
        pool = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz", "aeiou' 0129!?.,-ÄÖéßñ", "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(40))])
        odd.append("".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 20, 80, 400]))))
    return odd


def test_ids_and_texts_are_the_library_s():
    library, texts = Tokenizer.from_file(WORDS), strings()
    coded = bpe_codec.encoder(WORDS)(texts)
    for text, ids, want in zip(texts, coded, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert bpe_codec.decoded(WORDS, ids) == library.decode(want.ids, skip_special_tokens=False), text


def test_rounds_equal_the_heap():
    merges = bpe_codec.merges_of(WORDS)
    words = [w for t in strings(6) for w in merges.words(t) if len(w.encode()) <= bpe_codec.LONG]
    by_heap = [bpe_codec.merged_by_heap(merges, merges.symbols(w.encode()).tolist()) for w in words]
    assert merges.ordered and merges.encode_words(words) == by_heap
    merges.ordered = False  # one pair of a word at a time
    try:
        assert merges.encode_words(words) == by_heap
    finally:
        merges.ordered = True


def test_codec_on_odd_rows(spark, tmp_path):
    rows, library = odd_rows(), Tokenizer.from_file(WORDS)
    df = spark.createDataFrame(rows, DOCS).withColumn("bpe_ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    coded, ids = bpe_codec.encode(df, WORDS)
    back, text = bpe_codec.decode(coded, WORDS, ids)
    assert (ids, text) == ("_bpe_ids", "_decoded") and back.columns == [*df.columns, ids, text]
    for r in back.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r[ids] == want and r[text] == library.decode(want, skip_special_tokens=False)
    got = bpe_codec.op11_bpe_codec(spark, write(spark, tmp_path, rows)).collect()
    want = []
    for r in rows:
        x = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_codec_on_nothing(spark):
    assert bpe_codec.digests(spark.createDataFrame([], DOCS), WORDS).collect() == []


# --- filter audit --------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """Every order applied to every document."""
    first, has = {}, {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for i, quality, toxic in labels:
        old = has.get(i, (False, False))
        has[i] = (old[0] or quality == 1, old[1] or toxic == 1)
    cells = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and r[0] > first[text]}
        cells.append((r[2] or "", {k for k, v in fails.items() if v}, *has.get(r[0], (False, False))))
    out, shapley = {}, {}
    for part in {c[0] for c in cells}:
        for order in itertools.permutations("ABCDE"):
            left = [c for c in cells if c[0] == part]
            for step, x in enumerate(order, 1):
                gone = [c for c in left if x in c[1]]
                everyone = [c for c in cells if c[0] == part and x in c[1]]
                left = [c for c in left if x not in c[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(everyone) - len(gone), sum(c[1] == {x} for c in everyone), sum(c[2] for c in gone), sum(c[3] for c in gone))
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_every_order(spark, tmp_path):
    rng = random.Random(4)
    rows = odd_rows() + [(2000 + i, " ".join(rng.choice(["Ab", "c#", "d", "E", "fG", "hij"]) + str(rng.randrange(400)) for _ in range(rng.choice([90, 100, 150]))), rng.choice(["en", "de"]), "s", 1) for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 2040, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1)]
    labels.remove((0, *labels[0][1:]))
    got = filter_audit.op12_filter_audit(spark, write(spark, tmp_path, rows, labels))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    known = [x for x in labels if x[0] is not None]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, known)


def test_audit_on_nothing(spark, tmp_path):
    assert filter_audit.op12_filter_audit(spark, write(spark, tmp_path, [])).collect() == []


def test_lattice_of_three_filters(spark):
    assert len(filter_audit.edges_of(3)) == 12 and len(filter_audit.paths_of("XYZ")) == 18
    rows = spark.createDataFrame([("", m, False, False, 1) for m in range(8)], "part string, failed int, good boolean, toxic boolean, n long")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(rows, "XYZ").collect()}
    assert len(got) == 18 and [got["ZXY", s]["kept"] for s in (1, 2, 3)] == [4, 2, 1]
    # The Shapley sums of all filters are what all orders remove together.
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got.values()}.values()) == 6 * 7


# --- manifest ------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, extra=0):
    i, text, lang, source, n = row
    fields = [i, source, lang, None if n is None else n + extra, text]
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][a : a + 2]) for a in range(0, len(levels[-1]), 2)])
    return levels


def proof_of(levels, at):
    """(siblings, fold) up a tree."""
    steps = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        steps.append((at % 2, run[1 - at % 2] if len(run) > 1 else ""))
        at //= 2
    return steps


def brute_manifest(rows):
    parts = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        parts.setdefault(r[2], []).append((r[0], leaf_of(r), leaf_of(r, 1) if hit else None))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in names:
        parts[p].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[p] = tree_of([x[1] for x in parts[p]])
    top, out = tree_of([trees[p][-1][0] for p in names]), []
    for n, p in enumerate(names):
        for at, (i, leaf, changed) in enumerate(parts[p]):
            steps, now = proof_of(trees[p], at) + proof_of(top, n), changed or leaf
            for left, other in steps:
                now = digest(other, now) if left else digest(now, other)
            out.append((i, leaf, trees[p][-1][0], top[-1][0], digest(*[o for _, o in steps]), now, now == top[-1][0]))
    return sorted(map(str, out))


def test_manifest_against_lists(spark, tmp_path):
    rows = odd_rows()
    got = manifest.op13_manifest(spark, write(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(rows)


@pytest.mark.parametrize("tier", [1, 3])
@pytest.mark.parametrize("n", [1, 8, 9, 67])
def test_pages_of_several_tiers(spark, n, tier):
    """Small pages, so that trees have several tiers; one row in four is repeated over several pages."""
    rows = [(i // 4 if i < 40 else 3, f"t{i if i < 40 else 40}", "en" if i % 5 else None, "s", 1) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    out = manifest.manifest(df.select(F.col("lang").alias("part"), F.col("doc_id").alias("k"), manifest.leaf_digest(*fields).alias("digest"), F.lit(None).cast("binary").alias("tampered")), tier)
    plain = [eval(x) for x in brute_manifest(rows)]
    assert sorted((r["k"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in out.collect()) == sorted(x[:5] for x in plain)
    assert out.where("folded_root <> root").count() == 0


def test_manifest_on_nothing(spark, tmp_path):
    assert manifest.op13_manifest(spark, write(spark, tmp_path, [])).collect() == []
