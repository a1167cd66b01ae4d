"""Operators against brute force, exact round trips and odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import components, embedding_dedup, jaccard_join, line_dedup, packing, piece_codec, quality, sharding, substring_dedup, textkernel, token_counts, tokenizer, toxicity
from strandlake.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = tokenizer.default_path("piece_bpe_32k.model")
BYTES = tokenizer.default_path("byte_bpe_50k.json")


def corpus(seed=3, n=160):
    """Random texts with copies, near copies, shared passages, repeated rows and odd rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            words = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 8, 12, 30, 60, 200]))]
            if kind > 0.8:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage
        texts.append(words)
    joined = [("\n" if i % 3 else " ").join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) for i, w in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(joined)]
    odd = [None, "", " ", "\n\n", "one", "x" * 5000, "  two   spaces ", "🙂 👍🏽", "A B c d E", "a b C D e", "|" * 30, "word " * 3000]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd)]
    rows += [rows[5], rows[5], rows[-3]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like those the operators add."""
    extra = ["signals", "quality", "row_key", "marks", "removed_spans", "removed_lines", "piece_ids", "decoded", "k", "t", "h"]
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("in_one_task", [0, 1 << 20])
def test_components_of_chains_loops_and_stars(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(components, "EDGES_A_TASK", in_one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 6), (7, 6)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {200 + i: 200 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 ------------------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {q for at in windows.values() if len(at) > 1 for i in at for q in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, clashing, nothing):
    more = spark.createDataFrame([(2000, "a b c d e f g h " * 2 + "z " * 9 + "\n#\n#\n", "", "", 0)], DOCS)
    judged, q = quality.judge(docs.unionByName(more))
    for r in judged.select("text", f"{q}.*").collect():
        want = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
    assert quality.keep_good(clashing).columns == clashing.columns
    assert quality.keep_good(nothing).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def test_pieces_are_the_best_path_and_round_trip(docs, clashing, nothing):
    coded, ids = piece_codec.encode(docs, PIECES)
    back, text = piece_codec.decode(coded, PIECES, ids)
    assert back.where(F.coalesce("text", F.lit("")) != F.col(text)).count() == 0
    v = piece_codec.codec(PIECES)[0]
    words = sorted({"▁" + w for _, t, *_ in corpus() for w in (t or "").split()} | {"▁" + "aé🙂" * 9, "▁▁▁x", "▁"})
    words += ["▁" + w for w in ("tokens", "tokend", "tokeny") for _ in range(20)]
    for w, got in zip(words, piece_codec.encode_words(v, words), strict=True):
        assert got == piece_codec._spelled_out(v, w, piece_codec.viterbi_one(v, w))
    coded, ids = piece_codec.encode(clashing, PIECES)
    assert ids == "_piece_ids" and piece_codec.encode(nothing, PIECES)[0].count() == 0


def test_scalar_path_against_all_segmentations():
    v = piece_codec.codec(PIECES)[0]

    def best(word):
        totals = [0.0]
        for j in range(1, len(word) + 1):
            options = [totals[i] + v.score[v.id_of[word[i:j]]] for i in range(j) if word[i:j] in v.id_of and totals[i] is not None]
            totals.append(max(options, default=None))
        return totals[-1]

    for word in ("▁the", "▁understanding", "▁abcabc", "▁Edating"):
        assert sum(float(v.score[i]) for i in piece_codec.viterbi_one(v, word)) == pytest.approx(best(word))


# 3 and 7 ------------------------------------------------------------------------------------------------------------


def brute_marks(rows, segment):
    """(doc, place) of every chunk that is not the first place of its digest, by one table of all chunks."""
    places = collections.defaultdict(set)
    for key, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        digest, _, place, *_ = segment(raw, np.array([0, len(raw)]))
        for d, p in zip(digest.tolist(), place.tolist(), strict=True):
            places[d].add((key & 0xFFFFFFFFFFFFFFFF, p))
    later = collections.defaultdict(list)
    for at in places.values():
        for key, p in sorted(at)[1:]:
            later[key].append(p)
    return later


def keyed_rows(docs):
    return [(r.h, r.text) for r in docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").distinct().collect()]


def test_line_dedup_against_brute_force(spark, docs, clashing, nothing):
    block = "\n".join(f"line {i} of the shared block" for i in range(12))
    extra = [(3000 + i, f"own {i} start\nsecond {i}\n{block}\nend {i}", "", "", 0) for i in range(9)]
    df = docs.unionByName(spark.createDataFrame(extra, DOCS)).repartition(7)
    later = brute_marks(keyed_rows(df), line_dedup.segment)
    want = {}
    for key, text in keyed_rows(df):
        raw = (text or "").encode()
        _, _, place, start, end = line_dedup.chunk_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        gone = sum(raw.count(b"\n", a, b) + 1 for p, a, b in zip(place.tolist(), start.tolist(), end.tolist(), strict=True) if p in later[key & 0xFFFFFFFFFFFFFFFF])
        want[key] = gone
    out, gone = line_dedup.dedup_lines(df.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("old", F.col("text")), chosen=8)
    rows = out.collect()
    assert len(rows) == df.count() and sum(want.values()) > 50
    for r in rows:
        assert r[gone] == want[r.key]
        if not r[gone]:
            assert r.text == r.old
        else:
            left = len(r.text.split("\n")) if r.text else 0
            assert left + r[gone] in (len(r.old.split("\n")), len(r.old.split("\n")) - 1)
    cleaned, added = line_dedup.dedup_lines(clashing)
    assert added == "_removed_lines" and cleaned.columns == [*clashing.columns, added]
    assert line_dedup.dedup_lines(nothing)[0].count() == 0


def test_line_dedup_against_whole_texts(spark, docs):
    """The rule on plain lines, with nothing of the operator but the hash that orders the rows."""
    rows = {r.h & 0xFFFFFFFFFFFFFFFF: (r.text or "").split("\n") for r in docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").distinct().collect()}
    rows = {h: lines[:-1] if len(lines) > 1 and not lines[-1] else lines for h, lines in rows.items()}  # the end is no line
    first, gone = {}, collections.defaultdict(set)
    for h, lines in sorted(rows.items()):
        for p, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if first.setdefault(pair, (h, p)) != (h, p):
                gone[h] |= {p, p + 1}
    out, count = line_dedup.dedup_lines(docs.withColumn("h", F.xxhash64("doc_id", "text")), chosen=8)
    for r in out.collect():
        h = r.h & 0xFFFFFFFFFFFFFFFF
        assert r[count] == len(gone[h])
        if gone[h]:
            assert r.text.rstrip("\n") == "\n".join(x for p, x in enumerate(rows[h]) if p not in gone[h]).rstrip("\n")
    assert sum(map(len, gone.values())) > 50


def test_lines_are_cut_alike_after_insertions():
    rng = random.Random(5)
    lines = [f"{rng.random()}" for _ in range(200)]
    cut = lambda x: set(line_dedup.segment(np.frombuffer("\n".join(x).encode(), np.uint8), np.array([0, len("\n".join(x).encode())]))[0].tolist())
    a, b = cut(lines), cut(lines[:50] + ["new"] + lines[50:])
    assert len(a - b) <= 3


def lines_left(spark, texts, chosen=8):
    """The text of each of the texts after line dedup, and the number of lines removed from it; by default by every pair."""
    out, gone = line_dedup.dedup_lines(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS).repartition(3), chosen=chosen)
    return [(r.text, r[gone]) for r in out.orderBy("doc_id").collect()]


def test_every_repeated_run_of_lines_goes(spark):
    """Blocks of 2 to 20 lines in other surroundings, against a brute force over all runs of lines."""
    rng = random.Random(11)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(1, 5))]
    blocks = [[f"block {n} {k} {rng.random()}" for k in range(n)] for n in (2, 2, 3, 3, 4, 5, 6, 10, 20)]
    texts = ["\n".join(own() + rng.choice(blocks) + own() + rng.choice(blocks) + own()) for _ in range(40)]
    texts += ["\n".join(own() + b + own()) for b in blocks for _ in range(2)]
    keys = {r.doc_id: r.h & 0xFFFFFFFFFFFFFFFF for r in spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    first, runs = {}, collections.defaultdict(set)
    for i, t in sorted(enumerate(texts), key=lambda x: keys[x[0]]):
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                if first.setdefault(tuple(lines[a:b]), (i, a)) != (i, a):
                    runs[i].update(range(a, b))
    got = lines_left(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in runs[i]), len(runs[i]))
    assert all(sum(x in t.split("\n") for t, _ in got) == 1 for b in blocks for x in b)


def test_lines_repeated_over_and_over_stay_once(spark):
    same = ["top", *["the same line"] * 1000, "end"]
    turns = ["start", *["one", "two"] * 500, "stop"]
    got = lines_left(spark, ["\n".join(same), "\n".join(turns), "alone\n" + "\n".join(["x"] * 3), "\n".join(["blank"] + [""] * 40 + ["under"])])
    assert got == [("top\nthe same line\nend", 999), ("start\none\ntwo\nstop", 998), ("alone\nx", 2), ("blank\n\nunder", 39)]


def plain_chunks(lines, hashes):
    """(first line, its lines) of every digested run of lines, and the lines where chunks start, line by line."""
    n = len(lines)
    mask = (1 << 64) - 1
    rolled = [int(textkernel.mix(np.array([(hashes[i] * int(line_dedup._FACTOR) + hashes[i + 1] + int(line_dedup._SECOND)) & mask], np.uint64))[0]) for i in range(n - 1)]
    starts = [0]
    for i in range(1, n):
        value = i < n - 1 and rolled[i] >> 61 < line_dedup.CHOSEN or i < n - 2 and rolled[i] < min(rolled[i - 1], rolled[i + 1])
        same = i < n - 1 and rolled[i] == rolled[i - 1]
        if value or same or i - starts[-1] == line_dedup.LONGEST:
            starts.append(i)
    heads, longer = [], []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        b = min(max(b, a + 2), n)
        if b - a > 1:
            heads.append((a, tuple(lines[a : a + 2])))
        if b - a > 2:
            longer.append((a, tuple(lines[a:b])))
    return heads + longer, starts


def chunk_texts(seed=8):
    rng = random.Random(seed)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(1, 6))]
    blocks = [[f"block {n} {k} {rng.random()}" for k in range(n)] for n in [2, 2, 3, 3, 4, 5, 6, 8, 10, 20] * 4]
    texts = ["\n".join(own() + rng.choice(blocks) + own() + rng.choice(blocks) + own()) for _ in range(160)]
    texts += ["\n".join(["same"] * 50 + own()), "\n".join(["a", "b"] * 60), "\n".join(["a", "b"] * 40), "", "one line", "\n\n\n"] + ["\n".join(own() * 3)]
    return [t for t in texts] + texts[:3]


def test_chunks_by_their_definition():
    """Boundaries and digested runs of lines against plain loops; one digest for each run of lines."""
    said = collections.defaultdict(set)
    for t in chunk_texts():
        raw, off = np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])
        hashes, text, place, start, end = line_dedup.chunk_lines(raw, off)
        lines = [t.encode()[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        want, starts = plain_chunks(lines, hashes.tolist()) if lines else ([], [])
        digest, _, at = line_dedup.chunks(raw, off)
        assert not lines or line_dedup.chunk_starts(hashes, text, place).tolist() == starts
        assert at.tolist() == [a for a, _ in want]
        for d, (_, run) in zip(digest.tolist(), want, strict=True):
            said[d].add(run)
    assert all(len(x) == 1 for x in said.values()) and len({x for y in said.values() for x in y}) == len(said)


def test_boundaries_resist_shifts():
    rng = random.Random(5)
    lines = [f"{rng.random()}" for _ in range(400)]

    def cut(x):
        raw = np.frombuffer("\n".join(x).encode(), np.uint8)
        line, text, place = line_dedup.chunk_lines(raw, np.array([0, len(raw)]))[:3]
        return {x[i] for i in line_dedup.chunk_starts(line, text, place).tolist()}

    a, b = cut(lines), cut(lines[:200] + ["new", "newer"] + lines[200:])
    assert 120 < len(a) < 280 and len(a ^ b) <= 4


def test_chunks_find_most_repeated_runs(spark):
    """Against every pair of lines: nothing else goes, nine of ten lines do, and every run of eight lines or more is found."""
    texts = chunk_texts()
    every, some = lines_left(spark, texts), lines_left(spark, texts, line_dedup.CHOSEN)
    assert sum(n for _, n in some) >= 0.9 * sum(n for _, n in every) > 400
    for (t, _), (kept, n), old in zip(every, some, texts, strict=True):
        left, old_lines = collections.Counter(kept.split("\n")), collections.Counter(old.split("\n"))
        assert not kept or not left - old_lines and (n or kept == old)
    # No line is lost everywhere, and what goes would go by the rule of every pair as well (the first places may differ).
    before, after = {x for t in texts for x in t.split("\n")}, {x for t, _ in some for x in t.split("\n")}
    assert before - {""} <= after
    once = collections.Counter(x for t in texts for x in t.split("\n"))
    assert all(once[x] > 1 for (t, _), old in zip(some, texts, strict=True) for x in (collections.Counter(old.split("\n")) - collections.Counter(t.split("\n"))) if x)
    long = {x for t in texts for x in t.split("\n") if x.startswith(("block 8 ", "block 10 ", "block 20 "))}
    assert all(sum(x in t.split("\n") for t, _ in some) == 1 for x in long)


def test_repeated_lines_by_chunks(spark):
    same, turns = "\n".join(["top", *["the same line"] * 1000, "end"]), "\n".join(["start", *["one", "two"] * 500, "stop"])
    got = lines_left(spark, [same, turns], line_dedup.CHOSEN)
    assert got[0] == ("top\nthe same line\nend", 999) and got[1][1] > 900


def test_empty_lines_count_in_the_digest(spark):
    """A block that ends some texts and is followed by empty lines in others goes everywhere but once."""
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)
    digests = [tuple(line_dedup.segment(raw(t), np.array([0, len(t)]))[0].tolist()) for t in ("p1\np2", "p1\np2\n\n", "p1\np2\n\n\n", "\np1\np2", "p1\n\np2")]
    assert len(set(digests)) == len(digests)
    texts = [f"own {i}\npart one\npart two" + ("" if i % 3 == 0 else f"\n\nnext {i}") for i in range(30)]
    got = lines_left(spark, texts)
    assert sum("part one" in t for t, _ in got) == sum("part two" in t for t, _ in got) == 1
    assert all(f"own {i}" in t and (i % 3 == 0 or f"next {i}" in t) for i, (t, _) in enumerate(got))


def test_substring_dedup_against_brute_force(docs, clashing, nothing):
    later = brute_marks(keyed_rows(docs), substring_dedup.segment)
    want = {}
    for key, text in keyed_rows(docs):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        places = later[key & 0xFFFFFFFFFFFFFFFF]
        want[key] = [list(s) for s in substring_dedup.removed_spans(raw, places)] if places else []
    out, spans = substring_dedup.dedup_substrings(docs.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("old", F.col("text")))
    rows = out.collect()
    assert len(rows) == docs.count() and any(want.values())
    for r in rows:
        assert [list(s) for s in r[spans]] == want[r.key]
        raw, edges = (r.old or "").encode(), [0, *(x for s in want[r.key] for x in s), len((r.old or "").encode())]
        assert (r.text or "") == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
    cleaned, added = substring_dedup.dedup_substrings(clashing)
    assert added == "_removed_spans" and cleaned.columns == [*clashing.columns, added]
    assert substring_dedup.dedup_substrings(nothing)[0].count() == 0


def test_chunk_ends_against_the_rolling_sum():
    """Every boundary from its definition: a gear sum over the last 16 bytes, taken byte by byte."""
    rng = random.Random(21)
    weight = [int(x) & 0xFFFF for x in textkernel.mix(np.arange(1000, 1256, dtype=np.uint64))]
    for _ in range(40):
        texts = ["".join(rng.choice(["a", "bc ", " ", "\n", "é", "x" * 70, "日本"]) for _ in range(rng.randrange(90))) for _ in range(3)]
        want, base = [], 0
        for t, text in enumerate(texts):
            raw = text.encode()
            cuts = {0} if raw else set()
            for i in range(15, len(raw) - 1):
                rolled = sum(weight[raw[i - k]] << k for k in range(16)) & 0xFFFF
                blank = raw[i] in b" \t\n\v\f\r"
                solid = i >= 64 and not any(c in b" \t\n\v\f\r" for c in raw[i - 63 : i + 1]) and raw[i + 1] & 0xC0 != 0x80
                if blank and rolled % 3 == 0 or solid and rolled % 31 == 0:
                    cuts.add(i + 1)
            want += [(base + c, t) for c in sorted(cuts)]
            base += len(raw)
        raws = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raws)])
        start, text = substring_dedup.chunk_starts(np.frombuffer(b"".join(raws), np.uint8), offsets)
        assert list(zip(start.tolist(), text.tolist(), strict=True)) == want


def test_planted_passages_go_but_for_one(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(55))
    rows = [(i, " ".join(word() for _ in range(40)) + (f" {passage} " if i % 4 == 0 else " ") + " ".join(word() for _ in range(40)), "", "", 0) for i in range(40)]
    out, spans = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS))
    hit = {r.doc_id for r in out.where(F.size(spans) > 0).collect()}
    assert len(hit) == 9 and all(i % 4 == 0 for i in hit)


def test_shuffled_common_phrases_keep_their_text(spark):
    """Texts of phrases that all stand elsewhere, but never 20 words in one piece."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    phrases = [" ".join(word() for _ in range(7)) for _ in range(300)]
    texts = [" ".join(rng.sample(phrases, 30)) for _ in range(100)]
    seen, repeats = set(), 0
    for t in texts:
        w = t.split()
        mine = {tuple(w[k : k + 20]) for k in range(len(w) - 19)}
        repeats += len(mine & seen)
        seen |= mine
    assert not repeats
    out, spans = substring_dedup.dedup_substrings(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS))
    assert out.where(F.size(spans) > 0).count() == 0


@pytest.mark.parametrize("signs", ["的一是不了在人有我他这中大来上国", "ABCDEFGHabcdefgh01234567+/"])
def test_planted_passages_without_blanks_go_but_for_one(spark, signs):
    rng = random.Random(13)
    solid = lambda n: "".join(rng.choice(signs) for _ in range(n))
    passage = solid(3000)
    texts = [solid(500) + (passage if i % 4 == 0 else "") + solid(500) for i in range(24)] + [f"own {i} words {passage} and {i} more" for i in range(4)]
    out, spans = substring_dedup.dedup_substrings(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS))
    gone = {r.doc_id: sum(b - a for a, b in r[spans]) for r in out.collect()}
    size = len(passage.encode())
    assert all(0.9 * size < n <= size + 64 for n in gone.values() if n)
    assert sum(n > 0 for n in gone.values()) == 9 and all(i % 4 == 0 or i >= 24 for i, n in gone.items() if n)


def test_runs_of_texts_are_cut_as_single_texts(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t, *_ in corpus()]
    monkeypatch.setattr(textkernel, "RUN", 700)
    for segment in (substring_dedup.segment, line_dedup.segment):
        got = [(first + t, p, d) for first, data, off in textkernel.runs(pa.array(texts)) for d, t, p in zip(*[x.tolist() for x in segment(data, off)], strict=True)]
        alone = []
        for i, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            alone += [(i, p, d) for d, _, p in zip(*[x.tolist() for x in segment(raw, np.array([0, len(raw)]))], strict=True)]
        assert got == alone


# 4 ------------------------------------------------------------------------------------------------------------------


def test_shards_are_contiguous_balanced_and_gapless(docs, nothing):
    out = sharding.shard_by_bytes(docs, shards=7).collect()
    assert len(out) == docs.count() and sharding.shard_by_bytes(nothing).count() == 0
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for s, rows in by.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.slot)] == sorted(r.doc_id for r in rows)
        assert abs(sum(r["size"] for r in rows) - total / 7) <= largest
    assert all(max(r.doc_id for r in by[a]) <= min(r.doc_id for r in by[b]) for a, b in zip(sorted(by), sorted(by)[1:], strict=False))


def test_equal_rows_are_placed_in_stretches(spark, monkeypatch):
    """Rows that equal one another are one row with a count until they are placed."""
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = [(None, None)] * 1000 + [(1, "abc")] * 64 + [(1, "abd")] * 65 + [(i, "x" * i) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sharding.shard_by_bytes(df, shards=5).collect()
    want = collections.Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    total = sum(r["size"] for r in out)
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
        assert abs(sum(r["size"] for r in out if r.shard == s) - total / 5) <= 9


def test_an_id_on_many_texts_does_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, "")] * 500 + [(i, f"word{i} here") for i in range(2, 60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    old, toxicity.fit = toxicity.fit, lambda texts, y: seen.append(len(y)) or old(texts, y)
    try:
        toxicity.train(docs, marks, max_documents=30)
    finally:
        toxicity.fit = old
    assert seen[0] <= 30


# 5 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("group", "tile"), [(64, 8 << 20), (2, 2000)])
def test_jaccard_components_against_all_pairs(spark, docs, nothing, monkeypatch, group, tile):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", tile)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(30):
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        near.append((5000 + i, " ".join(words), "", "", 0))
    df = docs.unionByName(spark.createDataFrame(near, DOCS))
    rows = {r.doc_id: shingles(r.text) for r in df.collect()}
    ids = sorted(i for i in rows if rows[i])
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b])]
    want = union_find(rows, links)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(df).collect()]
    assert sorted(got) == sorted((r.doc_id, len(rows[r.doc_id]), want[r.doc_id]) for r in df.collect())
    assert len(links) > 60
    if group == 64:
        assert jaccard_join.near_components(nothing).count() == 0


def test_differences_from_a_hub_share_what_the_slack_says():
    rng, bands, seen = random.Random(8), jaccard_join.Bands(), collections.Counter()
    for _ in range(40_000):
        hub = set(range(rng.choice([8, 20, 45])))
        a = {x for x in hub if rng.random() > 0.2} | {100 + x for x in range(rng.randrange(1, 12))}
        b = set(a)
        for _ in range(rng.randrange(1, 9)):
            b ^= {rng.choice([*hub, *range(100, 130)])}
        sides = [(s, *bands.difference_slack(len(s), len(hub), len(s ^ hub))) for s in (a, b) if s]
        near = [100 * len(s & hub) >= 80 * len(s | hub) for s in (a, b)]
        if len(sides) < 2 or a == b or 100 * len(a & b) < 80 * len(a | b) or all(near):
            continue
        sides.sort(key=lambda x: x[1])
        shared = len((a ^ hub) & (b ^ hub))
        assert shared > sides[0][3] >= sides[0][2] and shared > sides[1][2]
        seen[sum(near)] += 1
    assert seen[0] > 500 and seen[1] > 200


def test_large_groups_of_near_copies_cost_rows_in_proportion(spark, monkeypatch):
    """3,000 variants of one text, most of them linked with few others: links as by all pairs, rows bounded linearly."""
    rng = random.Random(9)
    base, vocab = [f"w{i}" for i in range(120)], [f"x{i}" for i in range(300)]
    texts = []
    for i in range(3000):
        words = list(rng.choice(texts) if i % 5 == 0 and texts else base)
        for _ in range(rng.choice([1, 2]) if i % 5 == 0 else rng.randrange(2, 9)):
            words[rng.randrange(120)] = rng.choice(vocab)
        texts.append(words)
    rows = {i: shingles(" ".join(w)) for i, w in enumerate(texts)}
    number = {s: k for k, s in enumerate(sorted(set().union(*rows.values())))}
    holds = np.zeros((3000, len(number)), np.float32)
    for i, s in rows.items():
        holds[i, [number[x] for x in s]] = 1
    both, size = (holds @ holds.T).astype(np.int64), holds.sum(1).astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= 80 * (size[:, None] + size[None] - both), 1))
    want = union_find(rows, zip(a.tolist(), b.tolist(), strict=True))
    made, write = collections.Counter(), jaccard_join.materialise  # the most rows of each table that is written

    def counted(df, name):
        out = write(df, name)
        made[name] = max(made[name], out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    df = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in enumerate(texts)], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard_join.near_components(df).collect()} == want
    assert len(set(want.values())) > 300
    assert made["blocks"] <= 45 * 3000 and made["apart"] <= 45 * 3000
    assert made["hubs"] <= 8 * 3000 and made["spread"] <= 8 * 3000 and made["differences"] <= 45 * 3000


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rng.integers(0, 1 << 63, n // 5 + 1).astype(np.uint64)]))
        assert jaccard_join.hamming(jaccard_join.folded_sketch(a), jaccard_join.folded_sketch(b)) <= len(np.setxor1d(a, b))


# 6 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [4096, 16])
def test_embedding_links_against_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist(), int(i % 3)) for i in range(150)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [None, 1.0], 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] * 16, 1), (505, rows[0][1], None), (506, [1.0, 2.0], 0), (507, [], 0), rows[3], rows[3]]
    rows += [(600, base[0].tolist(), 2), (600, base[1].tolist(), 2), (601, base[0].tolist(), 2), (602, base[1].tolist(), 2), (603, base[1].tolist(), 2)]  # one id, two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = {k: i for k, i in enumerate(rows) if i[0] < 500 or i[0] in (506, *range(600, 604))}
    unit = {k: np.array(r[1]) / np.linalg.norm(r[1]) for k, r in ok.items()}
    pairs = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    degree = collections.Counter(x for p in pairs for x in p)
    part = union_find(range(len(rows)), pairs)
    smallest = {k: min(rows[j][0] for j in part if part[j] == part[k]) for k in part}
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect())
    assert got == sorted((r[0], degree[k], smallest[k], r[0] == smallest[k]) for k, r in enumerate(rows))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    odd = df.toDF("vec id", "e.b`d", "label").withColumns({c: F.lit(1) for c in ("id", "vec", "class", "h1", "dim", "rep", "component")})
    assert sorted(map(tuple, embedding_dedup.near_duplicates(odd, "vec id", "e.b`d", tile=tile).collect())) == got


# 8 ------------------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rng = random.Random(4)
    texts = [t or "" for _, t, *_ in corpus()] + ["x <|endoftext|> y<|endoftext|>", "don't\n\n  stop'll\t x　y", "\x1c a \x85 b"]
    texts += ["".join(rng.choice("ab '’s\n\t 1é日.") for _ in range(rng.randrange(40))) for _ in range(500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.id_bytes(BYTES)(texts)] == want


@pytest.mark.parametrize(("blank", "tail"), [(" ", ""), (" ", "x"), ("\t", "x"), ("\n", " x"), ("\u3000", "x")])
def test_long_runs_of_blanks_are_encoded_as_by_the_library(spark, blank, tail):
    from tokenizers import Tokenizer

    text = "a" + blank * 1_000_000 + tail
    ids = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenizer.id_bytes(BYTES)(["b", text, "c"])[1], "<u4").tolist() == ids
    if tail == "x":
        out = packing.pack(spark.createDataFrame([(1, text, "", "", 0), (2, "short", "", "", 0)], DOCS), BYTES).where("doc_id = 1").orderBy("piece").collect()
        assert sum(r.length for r in out) == len(ids) + 1
        assert out[-1].ids_crc32 == zlib.crc32(np.array([*ids, 2][out[-1].start :], "<u4").tobytes())


def test_packing_holds_every_piece_once(docs, nothing):
    out = packing.pack(docs, BYTES, capacity=64).collect()
    ids = dict(zip([r.doc_id for r in docs.collect()], [np.frombuffer(x, "<u4").tolist() + [2] for x in tokenizer.id_bytes(BYTES)([r.text or "" for r in docs.collect()])], strict=True))
    want = collections.Counter((r.doc_id, p, s, n, zlib.crc32(np.array(ids[r.doc_id][s : s + n], "<u4").tobytes())) for r in docs.collect() for p, (s, n) in enumerate(packing.cut(len(ids[r.doc_id]), 64)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(bins) <= -(-sum(r.length for r in out) // 64) + 3
    assert packing.pack(nothing, BYTES).count() == 0


def test_cut_makes_only_the_first_piece_shorter():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(1, 4) == [(0, 1)]


def test_fullest_is_the_best_subset_sum():
    import itertools

    rng = random.Random(0)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 60)
        best = max(s for pick in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(x * n for x, n in zip(counts, pick, strict=True))) <= room)
        got = packing.fullest(counts, room)
        assert sum(x * n for x, n in got) == best and all(n <= counts[x] for x, n in got)


def odd_names(docs):
    """The rows under names that need quoting, among columns named like those the operators use."""
    extra = ["k", "t", "h", "size", "crc", "part", "class", "token", "digest", "piece", "start", "length", "nth", "task", "y", "score"]
    return docs.select(F.col("doc_id").alias("doc.id"), F.col("text").alias("te`x.t"), *[F.lit(i).alias(c) for i, c in enumerate(extra)])


@pytest.mark.parametrize(
    "apply",
    [
        sharding.shard_by_bytes,
        jaccard_join.near_components,
        lambda df, *names: packing.pack(df, BYTES, *names).drop("sequence_id", "offset"),  # equal pieces may change places
        lambda df, *names: toxicity.score(df, toxicity.Model(np.linspace(-1, 1, toxicity.BUCKETS), -1.0, 0.1), *names),
        lambda df, *names: token_counts.count_tokens(df, PIECES, None, *names),
    ],
)
def test_odd_and_clashing_names_change_nothing(docs, apply):
    plain, odd = apply(docs), apply(odd_names(docs), "doc.id", "te`x.t")
    assert odd.columns == ["doc.id", *plain.columns[1:]]
    assert collections.Counter(map(repr, map(tuple, odd.collect()))) == collections.Counter(map(repr, map(tuple, plain.collect())))


# 9 ------------------------------------------------------------------------------------------------------------------


def test_toxic_sentences_are_learned_from_document_labels(spark):
    rng = random.Random(6)
    calm = ["".join(rng.choice("klmnop") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        sentences = [" ".join(rng.choice(calm) for _ in range(8)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            sentences[i % 6] += " Grobian" + rng.choice(["a", "b", ""])
        rows.append((i, ". ".join(sentences), "", "", 0))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    odd = spark.createDataFrame([(-1, None, "", "", 0), (-2, "", "", "", 0), (-3, "...", "", "", 0)], DOCS)
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(odd), model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and all((got[i].score >= 0.3) == (i % 5 == 0) for i in held)
    assert all(0 <= got[i].score <= 1 for i in got) and got[-1].score == got[-2].score == got[-3].score
    where = got[0].offending[0]
    assert "Grobian" in rows[0][1][where.start : where.end]
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, marks.limit(0)).weights.any() == np.False_
    few = toxicity.train(docs, marks, max_bytes=3 * 400 * 30)  # about 30 toxic texts and 60 others
    assert 0 < np.count_nonzero(few.weights) < np.count_nonzero(model.weights) + 50
    assert toxicity.train(docs.select(F.col("doc_id").alias("a.b"), F.col("text").alias("c.d")), marks.withColumnRenamed("doc_id", "a.b"), "a.b", "c.d").bias == model.bias
    assert {r.held_out for r in docs.select(toxicity.held_out("doc_id").alias("held_out")).collect()} == {True, False}


def test_scores_are_the_noisy_or_of_the_sentences(spark):
    """Words, word beginnings, buckets and the noisy-or, one by one in plain integers and floats."""
    rng = random.Random(17)
    full = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & full
        x = ((x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53) & full
        return x ^ (x >> 32)

    def bucket(part, k):
        value = sum(mixed(b + 1) * pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i, b in enumerate(part)) & full
        return (mixed((value + k) & full) >> 40) & (toxicity.BUCKETS - 1)

    weights = np.zeros(toxicity.BUCKETS)
    said = ["Bad", "worse", "kindness", "ünder", "x1", "longerword"]
    for w in said:
        raw = w.encode().lower()
        for k in (0, 4, 5, 6):
            if len(raw) > k:
                weights[bucket(raw[: k or None], k)] += rng.uniform(-3, 3)
    model = toxicity.Model(weights, -1.5, 0.25)
    texts = ["".join(rng.choice([*said, " ", " ", ", ", ". ", "!\n", "other"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS), model).collect()}
    for i, t in enumerate(texts):
        clean, wordless = 1.0, True
        for s in re.split(rb"[.!?\n]", t.encode()):
            words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", s)]
            if words:
                wordless = False
                found = {bucket(w[: k or None], k) for w in words for k in (0, 4, 5, 6) if len(w) > k}
                clean *= 1 - min(1 / (1 + np.exp(-(model.bias + sum(weights[b] for b in found)))), 1 - toxicity.MARGIN)
        want = model.empty if wordless else min(max(1 - clean, toxicity.MARGIN), 1 - toxicity.MARGIN)
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(4)
    text = np.sort(rng.integers(0, 12, 40))
    y = rng.integers(0, 2, 12).astype(float)
    pairs = np.unique(rng.integers(0, 40 * 9, 150))
    sentence, bucket = pairs // 9, pairs % 9

    def loss(v):
        p = 1 / (1 + np.exp(-np.array([v[bucket[sentence == s]].sum() + v[-1] for s in range(40)])))
        clean = np.array([np.prod(1 - p[text == t]) for t in range(12)])
        return -np.mean(np.where(y > 0, np.log(np.maximum(1 - clean, 1e-12)), np.log(clean)))

    keep = np.isin(np.arange(12), text) | (y == 0)
    y = np.where(keep, y, 0)  # a toxic text without sentences has no likelihood
    v = rng.normal(0, 0.5, 10)
    got = toxicity._slope(v[:-1], v[-1], bucket, sentence, text, y)
    step = 1e-5 * np.eye(10)
    assert np.allclose(got, [(loss(v + s) - loss(v - s)) / 2e-5 for s in step], atol=1e-6)


# 10 -----------------------------------------------------------------------------------------------------------------


def test_counts_are_the_library_s_and_come_from_the_cache(spark, docs, nothing, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    cache = f"file://{tmp_path}/cache"
    distinct = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    for _ in range(2):
        assert sorted(map(tuple, token_counts.count_tokens(docs, PIECES, cache).collect())) == want
        assert spark.read.parquet(cache).count() == distinct  # the second call encodes nothing
    assert token_counts.count_tokens(nothing, PIECES).count() == 0
    assert token_counts.count_tokens(docs, BYTES, cache).count() == len(want) and spark.read.parquet(cache).count() == 2 * distinct


def test_counts_equal_the_library_s_on_odd_strings():
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(23)
    parts = ["a", "b", "é", "x", "\u2581", "\u2581\u2581", "  ", " ", "\t", "\n", "the", "日本", "🙂", "\0", "\u3000", "ﬁ", "<s>", "<0x41>", "\u200d", "e\u0301"]
    texts = ["x\u2581 \u2581éa\u2581\t"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    assert tokenizer.counter(PIECES)(texts) == [len(x) for x in library.encode(texts)]
    assert tokenizer.words_are_apart(library)
