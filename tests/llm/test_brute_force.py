"""Result columns against plain recomputation, long texts, and rows that are null, repeated or clash."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import embedding_dedup, language_model, mixing, packing, pii, quality, simhash, tokens, top_k, toxicity
from tests.llm.test_llm import WORDS, level, text, words_of

# ---------------------------------------------------------------------------------------------- 1, 3, 4


def test_cuts_are_pieces_of_at_most_a_sequence():
    for n in (1, 2047, 2048, 2049, 4096, 5000):
        found = packing.cuts(n, 2048)
        assert sum(k for _, k in found) == n and found[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(found, found[1:], strict=False))
        assert len(found) == math.ceil(n / 2048) and all(k == 2048 for _, k in found[1:])


def test_a_gap_is_filled_by_three_where_one_or_two_do_not():
    counts = np.zeros(101, np.int64)
    counts[[50, 7, 13, 30]] = [2, 2, 2, 2]  # 50 + 7 + 13 + 30
    runs = packing.plan(counts, 100)
    assert max(r[3] + r[2] for r in runs.tolist()) == 2
    assert packing.pack  # the plan above is what pack places


def test_packing_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_keys_find_all_links(wide):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    one, two = (set(zip(k.tolist(), o.tolist(), strict=True)) for k, o in (simhash.keys_of(x, wide), simhash.keys_of(y, wide)))
    assert {o for _, o in one & two} == set(range(2000))


def test_unbroken_runs_take_linear_time():
    count = tokens.Counter("piece_bpe_32k.model")
    began = time.time()
    for t in ("x" * 300_000, "ab" * 200_000, " " * 200_000):
        assert count([t]) == [len(count.own.encode(t))]
    assert time.time() - began < 30


# ---------------------------------------------------------------------------------------------- 2, 5


def test_shared_keys_are_those_that_come_twice_however_batched():
    import pyarrow as pa

    rng = random.Random(4)
    keys = sorted(rng.choice(range(60)) for _ in range(90)) + [70] * 25
    rows = [(k, i) for i, k in enumerate(keys)]
    times = Counter(keys)
    place = [sum(x == k for x in keys[:i]) for i, k in enumerate(keys)]
    want = [(k, i, place[i] // 10) for i, k in enumerate(keys) if times[k] > 1]
    for size in (1, 2, 7, 200):
        batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + size]], pa.int64()), pa.array([n for _, n in rows[i : i + size]], pa.int64())], names=["key", "node"]) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in embedding_dedup.shared(iter(batches), 10) for r in b.to_pylist()]
        assert found == want
    assert sum(b.num_rows for b in embedding_dedup.shared(iter([]), 10)) == 0


def test_null_ids_of_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (20, [1.0, 0.1], 1), (None, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    found = {(r.vec_id, r.n_links): r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {(None, 2): 3, (3, 2): 3, (20, 2): 3, (None, 0): None}
    assert {(r.query_id, r.vec_id) for r in top_k.top_k(df, F.col("vec_id") % 20 == 0).collect()} == {(20, 3)}


# ---------------------------------------------------------------------------------------------- 6


def paths(grammar, symbols):
    """Every accepting path's (weight, output)."""
    todo = [(grammar.start, 0.0, "", symbols)]
    while todo:
        state, weight, out, rest = todo.pop()
        if not rest:
            if grammar.accepts(state):
                yield weight, out
            continue
        todo += [(to, weight + w, out + o, rest[1:]) for o, to, w in grammar.steps(state, rest[0])]


def test_best_path_is_the_heaviest_of_all():
    rng = random.Random(2)
    grammar = toxicity.grammar()
    for _ in range(300):
        symbols = "".join(rng.choice(toxicity.ALPHABET) for _ in range(rng.randrange(1, 8)))
        every = list(paths(grammar, symbols))
        best = max(w for w, _ in every)
        assert toxicity.best_path(grammar, symbols) in {o for w, o in every if w == pytest.approx(best)}


@pytest.mark.parametrize(("read", "written"), [("FMIF.", "FMxF."), ("IFFM", "xFFM"), ("RYFUFI", "RYFUFt"), ("I", "I"), ("MN.I", "MN.I")])
def test_mentions_and_direct_address(read, written):
    assert toxicity.best_path(toxicity.grammar(), read) == written


def test_isolated_words_do_not_make_a_text_toxic():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 2.0), {}, {})
    score = lambda t: 1 / (1 + np.exp(-(toxicity.shaped(lexicon.features(t)[None]) @ toxicity.PRIOR)[0]))
    for t in ("The word idiot is old. Stupid is a synonym. Moron too.", "idiot moron scum", "they said he is an idiot", "he is not an idiot"):
        assert score(t) < 0.2
    for t in ("he said you are an idiot, moron and scum and trash", "you idiot, you pathetic scum", "I will kill you", "du bist ein vollidiot und ein arschloch", "tu es un connard et une ordure", "eres un gilipollas y una escoria"):
        assert score(t) >= 0.7, t


def test_toxicity_of_odd_rows(spark):
    long = "la " * 400_000 + "you idiot, you pathetic scum, you worthless moron."
    df = spark.createDataFrame([(1, long, 1.0, 5), (1, long, 1.0, 5), (None, "x", 2.0, 6), (3, None, 2.0, 6)], "doc_id long, text string, score double, h long")
    labels = spark.createDataFrame([(1, None), (3, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    found = [(r.doc_id, r.predicted) for r in toxicity.score_toxicity(df, labels).collect()]
    assert Counter(found) == Counter([(1, 1), (1, 1), (None, 0), (3, 0)])


# ---------------------------------------------------------------------------------------------- 7


def test_quality_score_is_the_curve_over_pooled_marginals(spark):
    rng = random.Random(1)
    data = [(i, "\n".join(text(rng, 9) + ("." if i % 2 else " ###") for _ in range(1 + i % 6))) for i in range(80)] + [(200, None), (201, "\n" * 300), (5, "again"), (202, text(rng, 30_000))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(7, None)], "doc_id long, quality int")
    chain, line = quality.train(df, labels, "quality", "text", "doc_id", 4000)

    def want(t):
        x, w = quality.line_features(t or "")
        n = len(x)
        e = x @ chain.emission
        ahead = [np.array([1.0, math.exp(e[0])])]
        for k in range(1, n):
            a = (ahead[-1] / ahead[-1].sum()) @ np.exp(chain.transition)
            ahead.append(a * np.array([1.0, math.exp(e[k])]))
        back = [np.ones(2)]
        for k in range(n - 1, 0, -1):
            b = np.exp(chain.transition) @ (np.array([1.0, math.exp(e[k])]) * back[0])
            back.insert(0, b / b.sum())
        good = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, back, strict=True)]
        return 1 / (1 + math.exp(-(line[0] + line[1] * float(np.dot(good, w) / w.sum()))))

    expected = sorted((i, round(want(t), 6)) for i, t in data)
    assert sorted((r.doc_id, round(r.score, 6)) for r in quality.score_quality(df, labels).collect()) == expected


# ---------------------------------------------------------------------------------------------- 8


def segmentations(n, segments, at=0):
    if at >= n:
        yield []
        return
    for rest in segmentations(n, segments, at + 1):
        yield rest
    for i, j, names in segments:
        if i == at:
            for rest in segmentations(n, segments, j + 1):
                yield [(i, j, names), *rest]


def test_best_segmentation_is_the_best_of_all():
    field = pii.trained()
    for line in ("tel 030 1234567 or 555 123 4567", "ab at cd dot com 4111/1111/1111/1111", "key = 0123456789abcdef0a1b 12 12345678"):
        units = [m.span() for m in pii.UNIT.finditer(line)]
        segments = pii.candidates(line, units, [])
        value = lambda some: sum(max(field.scores(names)) for _, _, names in some)
        best = max(map(value, segmentations(len(units), segments)))
        found = field.best(len(units), segments)
        scores = {(i, j): max(field.scores(names)) for i, j, names in segments}
        assert sum(scores[i, j] for _, i, j in found) == pytest.approx(best)


def test_base_spans_against_patterns_stated_anew():
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card, phone = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    def good(kind, t):
        d = re.sub("[^0-9]", "", t)
        return {"email": True, "ip": all(int(p) <= 255 for p in t.split(".") if kind == "ip"), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    rng = random.Random(6)
    parts = ["a.b@c-d.com", "x@y", "_x@y.z.w_", "1.2.3.4", "1.2.3.400", "4111 1111 1111 1111", "+1 (017) 555-7713", "@", "+", "00", "a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "9.1.1.1.1.1", ".", "-", " "]
    for _ in range(3000):
        line = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        want = [(k, m.start(), m.end()) for k, p in (("email", email), ("ip", ip), ("card", card), ("phone", phone)) for m in re.finditer(p, line) if good(k, m.group())]
        assert pii.base_spans(line) == want, line


def test_spans_of_any_length_on_long_lines():
    field, began = pii.trained(), time.time()
    written = "a" + ".b" * 40 + " at " + " dot ".join(["c"] * 40) + " dot com"
    assert pii.find(written, field) == [("email_like", 0, len(written))]
    for line in ("x" * 1_000_000, "x" * 500_000 + "@" + "y" * 500_000, "1" * 500_000, "a." * 100_000 + "@", "1." * 20_000, "+1 " * 10_000, "1-" * 20_000, "12345 " * 3000):
        pii.find(line, field)
    assert time.time() - began < 60


def test_masking_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x"), (1, "a@b.com", "x"), (None, None, "y"), (2, "", "z")], "doc_id long, text string, spans string")
    found = pii.mask(df)
    assert found.columns == df.columns and Counter(map(tuple, found.collect())) == Counter([(1, "<EMAIL>", "x"), (1, "<EMAIL>", "x"), (None, None, "y"), (2, "", "z")])
    assert pii.mask(df.where("false")).count() == 0


# ---------------------------------------------------------------------------------------------- 9


def test_taken_is_that_of_the_queue_in_plain_words(spark):
    rng = random.Random(9)
    data = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 90, 400])), f"s{i % 5}" if i % 11 else None) for i in range(400)] + [(3, "w w w", "s3"), (900, None, "s0")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    placed = {r.doc_id: r.p for r in df.select("doc_id", mixing.place("doc_id", 17).alias("p")).collect()}
    rows = [(i, len(words_of(t)), s) for i, t, s in data]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s))
    target = level(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)})
    queues = defaultdict(Counter)
    for i, n, s in rows:
        queues[s][placed[i], i] += n
    copies = []
    for s, queue in queues.items():
        sent = 0
        for place, i in sorted(queue):
            sent += queue[place, i]
            if queue[place, i]:
                copies += [((sent + k * sizes[s]) / target[s], (s is not None, s or ""), k + 1, place, i, s, queue[place, i]) for k in range(3)]
    copies.sort()

    def cut(budget):
        taken, last, total = Counter(), {}, 0
        for _, _, k, place, i, s, n in copies:
            total += n
            if total > budget:
                break
            taken[s] += n
            last[s] = (k, place, i)
        return taken, last, {s: max(math.floor(target[s] + 1e-6) - taken[s], 0) for s in sizes}

    total = math.floor(sum(target.values()) + 1e-6)
    _, _, gap = cut(total)
    _, last, gap = cut(total - sum(gap.values()))
    want = Counter()
    for s in sizes:
        k, place, i = last.get(s, (1, -1, None))
        fill, fill_last = 0, None
        small = defaultdict(int)
        for j, n, other in rows:
            if other == s and 0 < n <= gap[s] // 4 and placed[j] > place:
                small[placed[j], j] += n
        for at in sorted(small):
            fill += small[at]
            if fill > gap[s]:
                break
            fill_last = at
        for j, n, other in rows:
            if other == s:
                at = (placed[j], j)
                inside = s in last and at <= (place, i) or (placed[j] > place and fill_last is not None and at <= fill_last and n <= gap[s] // 4 and k <= 3)
                want[j, n, n * ((k - 1 if s in last else 0) + inside)] += 1
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_report(df).collect()) == want


# ---------------------------------------------------------------------------------------------- 10


def test_model_score_is_that_of_plain_counts(spark):
    rng = random.Random(12)
    data = [(i, text(rng, rng.choice([2, 30, 150]))) for i in range(150)] + [(500, None), (501, "New words HERE"), (7, "again")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    marks = {r.doc_id: (r.t, r.h) for r in df.select("doc_id", (language_model.fold("doc_id", 7) != 2).alias("t"), (F.pmod(F.xxhash64(F.lit("weights"), F.col("doc_id").cast("string")), F.lit(language_model.HELD_OUT)) == 0).alias("h")).collect()}
    split = lambda t: [*words_of(t), None]
    follow = lambda own: list(zip([None, *own], own, strict=False))
    word, pair = Counter(), Counter()
    for i, t in data:
        if marks[i][0]:
            word.update(split(t))
            pair.update(follow(split(t)))
    total, uniform = sum(word.values()), 1 / (len(word) + 1)
    bucket = lambda c: c.bit_length()
    step = lambda p: round(language_model.STEPS * math.log2(p)) if p > 0 else 1
    cells = Counter()
    for i, t in data:
        if all(marks[i]):
            own, pairs = Counter(split(t)), Counter(follow(split(t)))
            for u, v in follow(split(t)):
                c = word[u] - own[u]
                cells[bucket(c), step((pair[u, v] - pairs[u, v]) / c if c else 0), step((word[v] - own[v]) / max(total - len(split(t)), 1))] += 1
    w = language_model.weights(np.array(list(cells)), np.array(list(cells.values()), float), uniform)

    def score(t):
        out = 0.0
        for u, v in follow(split(t)):
            a = w[bucket(word[u])]
            out += math.log10(a[0] * pair[u, v] / max(word[u], 1) + a[1] * word[v] / total + a[2] * uniform)
        return out

    want = sorted((i, round(score(t), 5)) for i, t in data)
    for options in ({}, {"chunk": 400, "bucket": 100}):  # documents of 150 words go on over chunks
        found = language_model.score(df, language_model.fold("doc_id", 7) != 2, **options).collect()
        assert sorted((r.doc_id, round(r.score, 5)) for r in found) == want


def test_a_huge_document_goes_on_over_chunks():
    own = list(language_model.pieces_of(" ".join(WORDS * 3), lambda: 7))
    assert [w for p, _ in own for w in p] == [w.encode() for w in WORDS * 3] and [e for _, e in own] == [False] * (len(own) - 1) + [True] and max(len(p) for p, _ in own) == 7


# ---------------------------------------------------------------------------------------------- pipeline


def test_pipeline_on_no_rows_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("none", []), ("some", [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (1, "entirely other words stand in here", "en", None, 34), (None, None, None, None, None)])):
        spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(packed) == bool(data) and len({r.sequence_id for r in packed}) == (1 if data else 0)
