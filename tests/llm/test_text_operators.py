"""Text operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradewell.llm import (bottomk, chat, decontam, line_dedup, links, packing, pairwise, pii, queries, rules,
                           textstats, tokens, wavelet)
from gradewell.llm.common import staged, table
from gradewell.llm.encode import Encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, sequence_id string, n_words string, ha string, kept string"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [None, "", "   ", "\n\n", "a  b   c \n\n d", "<|endoftext|> x<|endoftext|>y", "</s> <s>", "İstanbul ΣΑΣ \x85 \xa0 x́ I'LL",
       "½ ²x ªº × ÷ÿ", "▁a ▁ b", "trail  ", " lead", "short one", "short one", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a very long text, and columns with clashing names."""
    rows = [(i, t, "en", "s", "w", "h", "k") for i, t in enumerate(ODD)]
    rows += [(None, "no id here", None, None, None, None, None), (13, "short one", "en", "s", "w", "h", "k")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()),
                  key=lambda r: tuple((x is not None, x if not isinstance(x, list) else tuple(x)) for x in r))


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ op 2

@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_token_counts(name, request):
    df = request.getfixturevalue(name)
    model, safe = tokens.load_pieces(PIECE)
    assert safe
    want = sorted(((i is not None, i), len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096)
                  for i, t in texts(df))
    got = sorted(((r[0] is not None, r[0]), *r[1:]) for r in tokens.token_counts(df, PIECE, long_chars=500).collect())
    assert [g[1:] for g in got] == [w[1:] for w in want] and len(got) == df.count()


def test_safe_parts_give_the_counts_of_the_whole():
    model, _ = tokens.load_pieces(PIECE)
    for text in [LONG, "a  b " * 900, "x" * 9000, "a b ▁ c ▁▁d " * 300]:
        parts = tokens.safe_parts(text, 100)
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))


# ------------------------------------------------------------------ op 9, op 7

def _ids(path, text):
    from tokenizers import Tokenizer

    model = _ids.__dict__.setdefault(path, Tokenizer.from_file(path))
    return model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_library_ids(path, docs):
    encode = Encoder(path, limit=500)
    for text in [t or "" for t in ODD] + [t for _, t in texts(docs)][:60]:
        assert np.frombuffer(encode(text), "<u4").tolist() == _ids(path, text)


def test_wavelet_matrix_access_rank_select():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49_408, 3000), rng.integers(0, 3, 1500), np.zeros(5, int), np.zeros(0, int)):
        m, ends = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix(ids).to_bytes(np.array([len(ids)])))
        assert m.to_ids().tolist() == ids.tolist() and ends.tolist() == [len(ids)]
        for i in range(0, len(ids), 97):
            assert m.access(i) == ids[i]
            assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
            assert m.select(int(ids[i]), m.rank(int(ids[i]), i)) == i
        assert m.select(70_000, 0) == -1


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_token_documents(name, request):
    df = request.getfixturevalue(name)
    want, at = [], 0
    for i, t in sorted(texts(df), key=lambda x: (x[0] is not None, x[0], x[1])):
        ids = np.array([*_ids(WORD, t), 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = wavelet.token_documents(df, WORD, shard_tokens=700).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_packing(name, request):
    df = request.getfixturevalue(name)
    got = packing.pack_documents(df, BYTE, group_pieces=64).collect()
    want = []
    for i, t in texts(df):
        ids = np.array([*_ids(BYTE, t), 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r[0] or -1, *r[1:5]) for r in got) == sorted((w[0], *w[1:]) for w in want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and p[0][0] == 0 and sum(n for _, n in p) <= 1024


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 800)
    bins, offsets = packing.best_fit(sizes, (1024, 4, 300_000), rule=rule)
    for b in np.unique(bins):
        own = sizes[bins == b]
        assert own.sum() <= 1024 and len(own) <= 4 and (own ** 2).sum() <= 300_000
    bins, _ = packing.best_fit(sizes, (1024, 1024, 1 << 20), rule=rule)
    assert bins.max() + 1 <= 1.02 * sizes.sum() / 1024 + 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), (1024, 4, 1 << 20))


# ------------------------------------------------------------------ op 3, op 5

def _counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_quality_rules_counts(name, request, labels):
    df = request.getfixturevalue(name).where(F.coalesce(F.length("text"), F.lit(0)) < 6000)
    got = rules.quality_rules(df, labels).collect()
    want = sorted(_counts(t) for _, t in texts(df))
    assert sorted(tuple(r)[1:6] for r in got) == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    values = {"a": rng.random(600), "b": rng.random(600)}
    bad = (values["a"] > 0.7) & (values["b"] < 0.4)
    found = rules.learn_list(values, bad, ["a", "b"])
    marked = np.zeros(600, bool)
    for rule in found:
        marked |= np.logical_and.reduce([c.holds(values) for c in rule])
    assert found and (marked == bad).mean() > 0.97
    assert rules.learn_list(values, np.zeros(600, bool), ["a", "b"]) == []


def test_quality_scores_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = pairwise.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = got.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_learned_models_do_not_depend_on_the_layout_of_repeated_ids(spark, docs, labels):
    """Two texts under every labelled id: the one of least hash is learned from, wherever it lies."""
    other = docs.withColumn("text", F.concat(F.lit("### ### !! "), F.reverse("text")))
    both = docs.unionByName(other)
    layouts = [both.repartition(3), both.orderBy(F.desc("doc_id"), F.desc("text")), other.unionByName(docs).repartition(7)]
    for scores in (lambda d: pairwise.quality_scores(d, labels).select("doc_id", F.round("score", 9)),
                   lambda d: rules.quality_rules(d, labels).select("doc_id", "n_words", "kept")):
        first, *rest = [rows(scores(d)) for d in layouts]
        assert all(r == first for r in rest)


def test_quality_threshold_covers_labels_beyond_the_sample(docs, labels):
    """The share of open labelled documents below the level is that of bad ones, though few were fitted on."""
    got = pairwise.quality_scores(docs, labels, sample=30)
    known = got.where("NOT held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    below = sum(r["predicted"] == 0 for r in known)
    assert abs(below - sum(r["quality"] == 0 for r in known)) <= 1


def test_quality_scores_edges(odd, empty, labels):
    assert len(pairwise.quality_scores(odd, labels).collect()) == len(ODD) + 2
    assert pairwise.quality_scores(empty, labels).collect() == []
    one_kind = labels.where("quality = 1")
    assert {r["predicted"] for r in pairwise.quality_scores(odd, one_kind).collect()} == {1}
    assert set(pairwise.good_documents(odd, labels).columns) == set(odd.columns)


# ------------------------------------------------------------------ op 4

def test_base_spans_follow_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a1.2@-+ 9(") for _ in range(rng.randrange(40)))
        want = [(0, *m.span()) for m in email.finditer(text)]
        want += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in pii.base_spans(text) if s[0] < 2] == want
    assert pii.base_spans("pay 4012 8888-8888 1881 or 4012888888881882") == [(2, 4, 23)]
    assert pii.base_spans("call +1 (743) 555-3824.") == [(3, 5, 22)]
    assert pii.base_spans("9" * 200_000 + "@") == []


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    w = pii.new_weights(3, rng)
    x = rng.integers(0, pii.N_CLASSES, (6, 3))
    y = np.array([[0, 1, 0], [0, 1, 0], [2, 1, 0], [2, 0, 0], [0, 0, 3], [0, 4, 3]])
    _, g = pii.loss_and_gradient(w, x, y)
    for k in w:
        i = (0, 2) if k == "step" else tuple(rng.integers(0, s) for s in w[k].shape)
        w[k][i] += 1e-5
        up = pii.loss_and_gradient(w, x, y)[0]
        w[k][i] -= 2e-5
        down = pii.loss_and_gradient(w, x, y)[0]
        w[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-6


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float32) for k, v in pii.new_weights(4, rng).items()}
    w["step"] = rng.normal(0, 1, w["step"].shape).astype(np.float32)
    xs = [rng.integers(0, pii.N_CLASSES, n).astype(np.uint8) for n in (5, 2, 1, 4)]
    import itertools

    for x, got in zip(xs, pii.decode(w, xs)):
        order = list(range(len(x)))
        wide = {k: v.astype(float) for k, v in w.items()}
        f = pii._run(wide["xf"], wide["hf"], x[:, None], order)
        b = pii._run(wide["xb"], wide["hb"], x[:, None], order[::-1])
        e = [wide["ef"] @ f[t][-1] + wide["eb"] @ b[t][-1] + wide["bias"] for t in order]
        def worth(p):
            if any(pii.FORBIDDEN[a, c] for a, c in zip(p, p[1:])):
                return -np.inf
            return sum(e[t][k, 0] for t, k in enumerate(p)) + sum(wide["step"][a, c] for a, c in zip(p, p[1:]))
        assert tuple(got) == max(itertools.product(range(pii.TAGS), repeat=len(x)), key=worth)


def test_windows_cover_a_text_once():
    for n in (0, 1, 100, 416, 512, 513, 5000):
        bounds = pii.window_bounds(n, 512, 48)
        assert [b[2] for b in bounds[1:]] == [b[3] for b in bounds[:-1]] and bounds[0][2] == 0 and bounds[-1][3] == n
        assert all(e - s <= 512 + 48 and s <= f and last <= e for s, e, f, last in bounds)


def test_personal_data(docs, odd, empty):
    for df in (docs, odd):
        for r, (_, text) in zip(*[sorted(x, key=lambda v: (v[0] is not None, v[0] or 0)) for x in
                                  (pii.personal_data(df, sample=200).collect(), texts(df))]):
            base = pii.base_spans(text)
            if sum(i == r["doc_id"] for i, _ in texts(odd)) < 2:
                assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
                assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))
                assert [r[1 + k] for k in range(4)] == [sum(s[0] == k for s in base) for k in range(4)]
    assert pii.personal_data(empty).collect() == []


# ------------------------------------------------------------------ op 1

def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def _edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, how = rng.randrange(len(s) + 1), rng.randrange(3)
        if how == 0 or i == len(s):
            s.insert(i, rng.choice("abcd"))
        elif how == 1:
            s[i] = rng.choice("abcd")
        else:
            del s[i]
    return "".join(s)


def test_banded_distance_and_segment_keys():
    rng = random.Random(3)
    layout = line_dedup._layouts(25)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 70)))
        b = _edited(rng, a, rng.randrange(6))
        d = _distance(a, b)
        assert all(line_dedup.within(a, b, k) == (d <= k) for k in (1, 2, 3))
        x, y = sorted((a, b), key=len)
        if len(x) >= 25 and d <= line_dedup.threshold(len(x)):
            own = {(n, i, x[s:s + z]) for n, i, s, z in layout(len(x))[0]}
            assert own & {(n, i, y[s:s + z]) for n, i, s, z in sum(layout(len(y)), [])}


def test_line_verdicts_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(26, 120))).strip().ljust(26, "x") for _ in range(25)]
    docs = [(i, "\n".join(_edited(rng, rng.choice(base), rng.randrange(3)) for _ in range(rng.randrange(6)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "tiny\ntiny"), (63, docs[3][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, removed string")
    lines = [(i, n, x) for i, t in docs for n, x in line_dedup._lines(t or "", 25)]
    group = {x: x for _, _, x in lines}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in group:
        for b in group:
            if a < b and _distance(a, b) <= line_dedup.threshold(min(len(a), len(b))):
                group[find(a)] = find(b)
    first, want = {}, {i: [0, 0, 0, []] for i, _ in docs}
    for i, n, x in lines:
        f = first.setdefault(find(x), (i, n, x))
        want[i][0] += 1
        if f[:2] != (i, n):
            want[i][1] += 1
            want[i][2] += f[2] != x
            want[i][3].append(n)
    got = {r[0]: list(r)[1:] for r in line_dedup.line_verdicts(df).collect()}
    assert got == want
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    for i, t in docs:
        keep = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i][3])
        assert out[i] == keep


def _word_edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i, how = rng.randrange(len(words)), rng.randrange(3)
        words[i:i + (how > 0)] = [] if how == 1 else ["".join(rng.choice("efgh") for _ in range(rng.randrange(3, 7)))]
    return words


def test_long_lines_with_word_edits_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    lines = []
    for n in (18, 20, 50, 55, 60, 300, 600) * 2:
        base = [rng.choice(vocabulary) for _ in range(n)]
        lines += [" ".join(base)] + [" ".join(_word_edited(rng, base, k)) for k in (1, 1, 2, 3, 6)]
        lines += [_edited(rng, lines[-6], line_dedup.threshold(len(lines[-6])))]
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    group, wide = list(range(len(lines))), 0
    for j, b in enumerate(lines):
        for i, a in enumerate(lines[:j]):
            most = line_dedup.threshold(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= most and line_dedup.within(a, b, most):
                wide += not line_dedup.within(a, b, 2)
                group = [group[i] if g == group[j] else g for g in group]
    assert wide > 40
    first = {g: i for i, g in reversed(list(enumerate(group)))}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_verdicts(df).collect()}
    assert got == {i: int(first[g] != i) for i, g in enumerate(group)}


def test_lines_with_one_word_changed_are_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(500)]
    base = [rng.choice(vocabulary) for _ in range(500)]
    for words in (base[:50], base):                        # some 300 and 3,000 characters
        at = len(words) // 2
        texts_ = [words, words[:at] + ["replaced"] + words[at + 1:], words[:at] + ["put"] + words[at:], words[:at] + words[at + 1:]]
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts_)], "doc_id long, text string")
        assert rows(line_dedup.line_verdicts(df), "doc_id", "n_removed") == [(0, 0), (1, 1), (2, 1), (3, 1)]


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    line = lambda i: f"line number {i} of this test, " + hashlib.sha256(bytes([i])).hexdigest()
    a, b, c = line(1), line(2), line(3)
    for shared in (5, None):
        df = spark.createDataFrame([(shared, f"{b}\n{c}", 0), (shared, f"{a}\n{line(4)}", 1), (shared, f"{line(5)}\n{a}", 2),
                                    (shared, f"{b}\n{c}", 3), (9, f"{c}\n{line(6)}", 4), (9, None, 5)],
                                   "doc_id long, text string, n int")
        out = {r["n"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
        assert out[0] == out[3] == f"{b}\n{c}" and out[4] == line(6) and out[5] is None
        assert sorted((out[1] + "\n" + out[2]).split("\n")) == sorted([a, line(4), line(5)])
        verdicts = rows(line_dedup.line_verdicts(df), "doc_id", "n_lines", "n_removed")
        assert sorted(v[1:] for v in verdicts if v[0] == shared) == [(2, 0), (2, 0), (2, 1)]


def test_line_keys_travel_packed(spark):
    """A key of a line takes nine bytes at most in its block, and lines that share a run share a key."""
    rng = random.Random(17)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([40, 70, 300, 900]))).strip() for _ in range(300)]
    lines += [_edited(rng, x, 2) for x in lines[:60]]
    docs = spark.createDataFrame([("\n".join(lines[i::4]),) for i in range(4)], "text string")
    blocks = line_dedup.key_blocks(line_dedup.distinct_lines(docs, 25), 25, 8).collect()
    n = sum(len(r["keys"]) // 5 for r in blocks)
    assert n > 4000 and sum(len(r["keys"]) + len(r["steps"]) + len(r["info"]) for r in blocks) <= 9 * n
    for x, y in zip(lines, lines[300:]):
        runs = [{s[i:i + 25] for i in range(len(s) - 24)} for s in (x, y)]
        keys = [set(line_dedup.run_keys([s])[0].tolist()) for s in (x, y)]
        assert not runs[0] & runs[1] or keys[0] & keys[1]


@pytest.mark.parametrize("close", [1, 3, 128])
def test_pairs_and_list_entries_cover_all_that_share_a_key(close):
    rng = random.Random(close)
    entries = [(rng.randrange(40), rng.choice([100, 101, 103, 130]), rng.random() < 0.3, i) for i in range(400)]
    entries += [(7, 100, False, 5)] * 3
    packed = np.array([k << 16 | n << 1 | p for k, n, p, _ in entries], np.uint64)
    a, b, dense, ids = line_dedup._meet(packed, np.array([e[3] for e in entries], np.int64), close)
    keys = set((dense >> np.uint64(16)).tolist())
    assert (close == 128) == (not keys) and len(dense) == len({e for e in entries if e[0] in keys})
    expected = {(min(x[3], y[3]), max(x[3], y[3])) for x in entries for y in entries
                if x[0] == y[0] and x[0] not in keys and x[3] != y[3] and not (x[2] and y[2])
                and abs(x[1] - y[1]) <= line_dedup.threshold(min(x[1], y[1]))}
    assert set(zip(a.tolist(), b.tolist())) == expected and len(a) == len(expected)


def test_lines_under_crowded_keys_are_linked(spark, monkeypatch):
    """The same verdicts where buckets make no pairs themselves."""
    rng = random.Random(23)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 80, 150, 400)]
    rows = [(i, "\n".join(_edited(rng, x, rng.randrange(3)) for x in bases)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = sorted(map(tuple, line_dedup.line_verdicts(df).collect()), key=str)
    found = line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda blocks: found(blocks, 1))
    assert sorted(map(tuple, line_dedup.line_verdicts(df).collect()), key=str) == before
    assert sum(r[2] for r in before) > 20


def test_only_pairs_with_fitting_characters_are_made(spark, monkeypatch):
    """Lines that share a run and are not alike give no pairs, and of many alike under a key the pairs are not all made."""
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    run, base = text(40), "".join(rng.choice("ijklmnop") for _ in range(150))
    lines = [f"x{run}{text(110)}{i % 10}" for i in range(60)] + [base[:i] + "yz" + base[i + 2:] for i in range(90, 149)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    distinct = line_dedup.distinct_lines(docs, 25).persist()
    entries = line_dedup.candidates(line_dedup.key_blocks(distinct, 25, 8).repartitionById(8, F.col("bucket")))
    dealt = entries.join(distinct.select("id", "trait.*"), "id").repartitionById(8, F.col("bucket")).persist()
    text_of = dict(map(tuple, distinct.select("id", "line").collect()))
    pairs = lambda df: {(r["a"], r["b"]) for r in df.collect() if r["key"] is None}
    alike = lambda p: line_dedup.within(text_of[p[0]], text_of[p[1]], line_dedup.threshold(150))
    whole = pairs(line_dedup.met(dealt))
    expected = {(a, b) for a in text_of for b in text_of if a < b and alike((a, b))}
    assert len(expected) > 1500 and expected <= whole and len(whole - expected) < 200
    verdicts = sorted(map(tuple, line_dedup.line_verdicts(docs).collect()), key=str)
    met = line_dedup.met
    monkeypatch.setattr(line_dedup, "met", lambda entries: met(entries, 4))
    found = line_dedup.met(dealt)
    assert len(pairs(found)) < 500 and found.where("key IS NOT NULL AND trait IS NOT NULL").count() > 0
    assert sorted(map(tuple, line_dedup.line_verdicts(docs).collect()), key=str) == verdicts
    assert sum(r[2] for r in verdicts) == 58


def test_few_pairs_of_many_near_copies_are_verified(spark, monkeypatch):
    """Lines that fall into one class through some of them are not all compared with one another."""
    rng = random.Random(37)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200))
    lines = sorted({base[:i] + rng.choice("ijklmnop") + base[i + 1:] for i in rng.choices(range(60, 200), k=900)})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    made, verify_with = [], line_dedup.verify_with

    def counting(*args):
        verify = verify_with(*args)
        return lambda pairs: made.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(line_dedup, "verify_with", counting)
    assert sum(r["n_removed"] for r in line_dedup.line_verdicts(docs).collect()) == len(lines) - 1
    assert len(lines) > 500 and sum(made) < len(lines) * (len(lines) - 1) / 6


def test_runs_at_far_places_give_no_pairs(spark):
    """A run that two lines share near the begin of one and the end of the other gives no pair."""
    rng = random.Random(41)
    run = "".join(rng.choice("abcdefgh") for _ in range(30))
    half = sorted("".join(rng.choice("abcdefgh") for _ in range(270)))
    shuffled = lambda: "".join(rng.sample(half, len(half)))
    lines = [run + shuffled() for _ in range(10)] + [shuffled() + run for _ in range(10)]
    docs = spark.createDataFrame([(x,) for x in lines], "text string")
    distinct = line_dedup.distinct_lines(docs, 25).persist()
    entries = line_dedup.candidates(line_dedup.key_blocks(distinct, 25, 8).repartitionById(8, F.col("bucket")))
    dealt = entries.join(distinct.select("id", "trait.*"), "id").repartitionById(8, F.col("bucket"))
    first = {r["id"]: r["line"].startswith(run) for r in distinct.select("id", "line").collect()}
    pairs = {(r["a"], r["b"]) for r in line_dedup.met(dealt).collect() if r["key"] is None}
    assert pairs and all(first[a] == first[b] for a, b in pairs)


def test_shuffle_files_go_when_a_step_is_written(spark):
    """A staged table's shuffle files are gone without a garbage collection, and the setting is as before."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(setting, None), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = lambda: manager.diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")
    held = files()
    out = staged(spark.range(5000).repartition(7, "id"), "cleaned")
    deadline = time.time() + 20
    while files() > held and time.time() < deadline:
        time.sleep(0.1)
    assert files() <= held and out.count() == 5000 and spark.conf.get(setting, None) == before


def test_pairs_are_verified_many_at_a_time():
    rng = random.Random(29)
    xs = ["".join(rng.choice("abc \u4e00\U0001f600") for _ in range(rng.choice([25, 60, 120, 600, 1500]))) for _ in range(300)]
    ys = [_edited(rng, x, rng.randrange(line_dedup.threshold(len(x)) + 3)) for x in xs]
    expected = [line_dedup.within(x, y, line_dedup.threshold(min(len(x), len(y)))) for x, y in zip(xs, ys)]
    assert line_dedup.all_within(xs, ys).tolist() == expected and 100 < sum(expected) < 300


def test_pieces_between_white_space_give_the_library_s_ids():
    """Words are looked up with their marks where the pattern leaves white space out, and nowhere else."""
    from tokenizers import Tokenizer

    texts = ["It's  a\ntest, don't (you) see? 12.5% \n\n of caf\u00e9's", " x", "a ", "'s 't", "", "<| a", "tab\there"]
    for path, apart in ((WORD, True), (BYTE, False)):
        encode, full = Encoder(path, limit=3), Tokenizer.from_file(path)
        assert encode.apart == apart
        for text in texts + texts:
            ids = full.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode(text), np.uint32).tolist() == ids
        assert bool(encode.pieces) == apart and len(encode.pieces) <= 3


def test_line_dedup_edges(odd, empty):
    assert line_dedup.line_verdicts(empty).collect() == []
    assert line_dedup.dedup_lines(odd).count() == len(ODD) + 2


# ------------------------------------------------------------------ op 6

def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    group = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = dict(map(tuple, links.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: g for n, g in group.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("size,percent", [(4, 80), (2, 60)])
def test_near_duplicates_against_all_pairs(spark, size, percent):
    rng = random.Random(7)
    made = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 25)):
            copy = [w if rng.random() > 0.02 else f"z{rng.randrange(900)}" for w in base]
            made.append(" ".join(copy).replace("w1", "W1"))
    made += [None, "", " \n", "one", "ONE", "one two"]
    docs = list(enumerate(made))
    docs.append((2, docs[2][1]))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")

    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split()
        n = min(size, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for _, t in docs]
    group = [i for i, _ in docs]
    for _ in range(8):
        for x in range(len(docs)):
            for y in range(x):
                both = len(sets[x] & sets[y])
                if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    group[x] = group[y] = min(group[x], group[y])
    want = sorted((i, len(s), g, i == g) for (i, _), s, g in zip(docs, sets, group))
    assert sorted(map(tuple, bottomk.near_duplicates(df, size=size, percent=percent).collect())) == want


def test_long_lists_are_refined_without_loss(spark, monkeypatch):
    """Many copies that differ much: hubs and refined lists find what all pairs find."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.03 else f"z{rng.randrange(10 ** 6)}" for w in base)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    steps = []
    live = links._live
    monkeypatch.setattr(links, "_live", lambda e, c: steps.append(1) or live(e, c))
    got = {r["doc_id"]: r["component_id"] for r in bottomk.near_duplicates(df, size=4).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(4)])) for _, t in docs]
    group = list(range(150))
    for _ in range(10):
        for x in range(150):
            for y in range(x):
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    group[x] = group[y] = min(group[x], group[y])
    assert got == dict(enumerate(group)) and len(steps) > 1


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(90)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    table_ = [(1, a), (1, a), (2, a + " end"), (3, b), (1, b), (7, c), (7, c + " end"), (None, d), (None, d + " end"),
              (None, a), (None, e), (8, e), (9, ""), (9, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(table_)], "doc_id long, text string, n int")
    kept = rows(corpus_pipeline.near_dedup(spark, df, SF))
    got = [r[:2] for r in kept]
    group = {t: g for g, x in enumerate((a, b, c, d, e)) for t in (x, x + " end")}
    assert sorted(group[t] for _, t in got if t) == [0, 1, 2, 3, 4] and got.count((9, "")) == 2
    assert {group[t]: i for i, t in got if t} == {0: 1, 1: 1, 2: 7, 3: None, 4: 8}


def test_near_duplicates_edges(odd, empty):
    got = bottomk.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert bottomk.near_duplicates(empty).collect() == []


# ------------------------------------------------------------------ op 8

def test_chat_round_trip(spark):
    sly = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s>", "[\\/INST]", "a</", "<s", "", None, "x\ny", "\\", "$1"]
    data = [(c, t, r, x, "q") for c in range(4) for t, (r, x) in
            enumerate((random.Random(c * 50 + k).choice(["user", "assistant", "sys</s>tem", None]), x) for k, x in enumerate(sly))]
    data += [(None, 0, "user", "hi", "q"), (None, None, "assistant", "yo", "q"), (9, 0, "user", "x", "q"), (9, 0, "user", "x", "q")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in {d[0] for d in data}:
        turns = sorted(((t is not None, t, r or "", x or "") for cc, t, r, x, _ in data if cc == c), key=lambda k: (k[0], k[1] or 0, *k[2:]))
        assert [tuple(t) for t in got[c]["turns"]] == [t[2:] for t in turns]
        assert got[c]["learned"] == "".join(t[3] for t in turns if t[2] == "assistant")
    assert chat.format_chats(df.limit(0)).collect() == []


# ------------------------------------------------------------------ op 10

def test_contamination_against_all_windows(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd ef Gh".split()) if rng.random() < 0.9 else "é1"
    items = [(f"i{k}", " ".join(word() for _ in range(rng.randrange(14)))) for k in range(30)] + [(None, "Ab, cd"), ("n", None), ("i1", "é1 é1")]
    made = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(80)]
    for k in range(0, 80, 3):
        made[k] += " -- " + (items[k % 30][1] or "").upper()
    docs = list(enumerate(made)) + [(None, "ab cd"), (5, made[5]), (90, None), (91, "")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    want = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b:b + n] == v[a:a + n]:
                        hit |= set(range(b, b + n))
                        names.add(name or "")
        ids = ",".join(sorted(names))
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    key = lambda r: (r[0] is not None, r[0] or 0)
    for block_bytes in (1 << 20, 60):
        got = decontam.contamination(df, bench, block_bytes=block_bytes, shard_bytes=300).collect()
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    clean = decontam.clean_documents(df, bench).collect()
    assert sorted((r["doc_id"] or -1) for r in clean) == sorted((w[0] or -1) for w in want if not w[5])


def test_longest_match_among_items_that_share_a_passage():
    rng = random.Random(14)
    shared = [f"s{i}" for i in range(12)]
    items = [[f"{k}a{i}" for i in range(rng.randrange(4))] + shared + [f"{k}b{i}" for i in range(8)] for k in "xyz"]
    texts_ = [["o"] + shared + [f"{k}b{i}" for i in range(5)] + ["o"] for k in "xyz"] + [shared[:9], shared, items[1]]

    def brute(words):
        return max((n for x in items for i in range(len(x)) for n in range(10, len(x) - i + 1)
                    if any(words[j:j + n] == x[i:i + n] for j in range(len(words)))), default=0)

    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        block = decontam.TestBlock([(str(i), " ".join(items[i])) for i in order], 10)
        longest = decontam.find([[w.encode() for w in t] for t in texts_], block)[3]
        assert longest.tolist() == [brute(t) for t in texts_]


def test_contamination_edges(spark, odd, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    assert {r["contaminated"] for r in decontam.contamination(odd, none).collect()} == {False}
    assert decontam.contamination(empty, none).collect() == []


# ------------------------------------------------------------------ queries and pipeline

def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == names
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if name == "line_dedup":
            assert len(ids) == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in packed} == ids
    scores = {r["doc_id"]: r["predicted"] for r in pairwise.quality_scores(docs, table(spark, SF, "labels")).collect()}
    assert ids <= {i for i, p in scores.items() if p == 1}


def test_statistics_helpers():
    assert textstats.counts("", [])["symbol_share"] == 0
    assert textstats.repeated_words("a b c d e a b c d e".encode().split()) == 10


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(8)
    for n in (0, 1, 30, 400, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10:], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        apart = sum(int(x).bit_count() for x in bottomk.parity(a) ^ bottomk.parity(b))
        assert apart <= len(np.setxor1d(a, b))


def test_near_duplicates_among_many_texts_alike_but_not_enough(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(400):                    # near copies with up to nine words changed each
        words = list(base)
        for p in rng.integers(0, 90, rng.integers(0, 10)):
            words[p] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    out = {r.doc_id: r for r in bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(bottomk.shingle_set(t, 5).tolist()) for _, t in rows]
    least = list(range(400))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    assert {i: r.component_id for i, r in out.items()} == {i: root(i) for i in range(400)}
