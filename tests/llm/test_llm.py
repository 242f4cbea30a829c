"""Every operator against brute force on small tables, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import embedding_dedup, language_model, mixing, packing, pii, quality, simhash, tokens, top_k, toxicity

WORDS = [f"{a}{b}" for a in ("ba", "do", "ke", "mi", "su", "ra") for b in ("n", "ta", "lor", "pi", "ve")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, text(rng, rng.choice([1, 3, 8, 40, 200])), f"s{min(i % 7, 3)}") for i in range(120)]
    out += [(200, None, None), (201, "", "s0"), (202, " \n\t ", "s1"), (203, text(rng, 9000), "s2"), (204, out[3][1], "s0"), (5, out[5][1], out[5][2]), (205, "same", None), (None, "no id here", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [r + (1, 2, 3, 4, "x", "y") for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, source string, size long, length long, fp long, n long, label string, score string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words_of(t):
    return (t or "").encode().lower().split()


# ---------------------------------------------------------------------------------------------- 1 packing


def test_packing_places_every_piece_once(docs, rows):
    found = [r.asDict() for r in packing.pack(docs, keep_ids=True).collect()]
    encode = packing.encoder("byte_bpe_50k.json")
    want = Counter()
    for i, t, *_ in rows:
        ids = [*encode(t or "").tolist(), 0]
        for k, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = {}
    for r in found:
        assert len(r["ids"]) == r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in found) / 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_a_packing_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.clip(rng.lognormal(3 + seed / 3, 1, 3000).astype(int), 1, 128), minlength=129)
    runs, used, fill = packing.plan(counts, 128), Counter(), {}
    for length, first, n, sequence, offset in runs.tolist():
        assert first == used[length]
        used[length] += n
        for i in range(n):
            fill.setdefault(sequence + i, []).append((offset, length))
    assert all(used[k] == n for k, n in enumerate(counts) if k)
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(fill) <= math.ceil((np.arange(129) * counts).sum() / 128) * 1.02 + 1


def test_encoder_is_that_of_tokenizers():
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    encode = packing.encoder("byte_bpe_50k.json")
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x3000, 0xD000), 32, 10, 39])) for _ in range(rng.randrange(40)))
        for some in (t, t + "<|endoftext|>" + t):
            assert encode(some).tolist() == slow.encode(some, add_special_tokens=False).ids


# ---------------------------------------------------------------------------------------------- 2 vectors


def vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 16))
    out = [(int(i), (centre[i % 6] + rng.standard_normal(16) * (0.08 if i % 3 else 1)).astype(np.float32).tolist(), int(i % 2)) for i in range(300)]
    out += [(400, out[1][1], out[1][2]), (401, out[1][1], out[1][2]), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, [None, 1.0], 1), (406, out[1][1], None), (407, [float("inf")] + [0.0] * 15, 0), (408, [1.0, 2.0], 0), (7, out[7][1], out[7][2])]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit(1), "v": F.lit(2), "node": F.lit(3)}), out


def test_vector_links(spark):
    df, out = vectors(spark)
    good = [(i, np.pad(np.array(v, np.float64), (0, 16 - len(v))), y) for i, v, y in out if v is not None and None not in v and np.isfinite(v).all() and any(v) and y is not None]
    n, parent = Counter(), {i: i for i, _, _ in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a] += 1
                n[b] += 1
                links[i, j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = Counter((i, n[k], root(i)) for k, (i, _, _) in enumerate(good))
    found = embedding_dedup.near_duplicates(df, recall=0.9999).collect()
    assert len(found) == len(out)
    got = {r.vec_id: r for r in found}
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in found if r.vec_id in {g[0] for g in good}) == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (402, 403, 404, 405, 406, 407))
    blocks = embedding_dedup.near_duplicates(df, recall=0.9999, block=10).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_vector_links_with_the_parameters_of_the_query(spark):
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.9305 * a + math.sqrt(1 - 0.9305**2) * b])  # pairs just over the threshold, where hashing finds fewest
    near = x @ x.T >= 0.93
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    links, want = sum(r.n_links for r in found), int(near.sum()) - len(x)
    assert 0.997 * want <= links <= want


# ---------------------------------------------------------------------------------------------- 3 fingerprints


def test_keys_are_complete():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    one, two = (set(zip(k.tolist(), o.tolist(), strict=True)) for k, o in (simhash.keys_of(x), simhash.keys_of(y)))
    assert {o for _, o in one & two} == set(range(3000))


def plain_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(docs, rows, none):
    found = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((i, f"{f:016x}") for i, f in prints)
    different = sorted({f for _, f in prints})
    parent = {f: f for f in different}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in different:
        for b in different:
            if a < b and (a ^ b).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    first = {}
    for i, f in prints:
        if i is not None:
            first[root(f)] = min(first.get(root(f), i), i)
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, first.get(root(f))) for i, f in prints)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root(f) for _, f in prints})


def test_one_row_of_each_group_is_kept_whatever_its_id(spark):
    rng = random.Random(8)
    a, b, c, d, e, f, g, h = (text(rng, 60) for _ in range(8))
    data = [(None, a), (None, b), (None, c), (None, c)]  # three texts without an id
    data += [(1, d), (1, e), (7, e)]  # an id on two texts, each the smallest of its group
    data += [(2, f), (3, f), (3, g), (None, f)]  # 3 is kept for g, not for its copy of f; nor is the null id's
    data += [(4, h), (4, h), (5, None), (6, "")]
    kept = simhash.keep_first(spark.createDataFrame(data, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, a), (None, b), (None, c), (1, d), (1, e), (2, f), (3, g), (4, h), (5, None)])
    named = spark.createDataFrame([(1, "one two three", "x"), (2, "one two three", "y")], "key long, body string, __x string")
    assert [tuple(r) for r in simhash.keep_first(named, "body", "key").collect()] == [(1, "one two three", "x")]


@pytest.mark.parametrize("large", [4096, 40])
def test_crowded_buckets_lose_no_link(spark, large):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**62, 5, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(150):
            f = int(c)
            for b in rng.choice(64, int(rng.integers(0, 7)), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), large=large).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 4 for e in edges)

    def parts(pairs):
        parent = {f: f for f in signed}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {f: root(f) for f in signed}

    every = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert parts((e.a, e.b) for e in edges) == parts(every)


def test_components_of_a_chain_and_a_star(spark):
    from granary.llm.common import components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------------------------------------- 4 token counts


def test_spliced_counts_are_those_of_whole_texts():
    small = tokens.Counter("piece_bpe_32k.model", huge=150, chunk=90, overlap=6)
    rng = random.Random(9)
    some = ["".join(rng.choices(list("ab 12\n▁.é漢😀\u0000<s>/"), k=rng.randrange(900))) for _ in range(150)] + ["a" * 2000, " " * 2000, "▁ " * 300, ""]
    assert small(some) == [len(x) for x in small.own.encode(some)]


def test_token_counts(docs, rows, none):
    own = tokens.Counter("piece_bpe_32k.model").own
    want = Counter((i, len((t or "").encode()), len(own.encode(t or "")), len(own.encode(t or "")) > 4096) for i, t, *_ in rows)
    assert Counter(map(tuple, tokens.token_counts(docs).collect())) == want
    assert tokens.token_counts(none).count() == 0
    assert tokens.token_counts(docs, tokenizer="word_bpe_49k.json").count() == len(rows)


# ---------------------------------------------------------------------------------------------- 5 search


def test_top_k_is_exact(spark):
    df, out = vectors(spark)
    is_query = F.col("vec_id") % 20 == 0
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (16 - len(v))) for i, v, _ in out if v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for i, x in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in good if j != i)[:5]
            for k, (s, j) in enumerate(best):
                want[i, k + 1, j, -s] += 1
    assert Counter(map(tuple, top_k.top_k(df, is_query).collect())) == want
    assert Counter(map(tuple, top_k.top_k(df, is_query, at_once=4).collect())) == want
    assert top_k.top_k(df.where("false"), is_query).count() == 0
    few = spark.createDataFrame([(20, [1e18, 2.0]), (21, [1e18, -1.0]), (22, [0.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in top_k.top_k(few, is_query).orderBy("rank").collect()] == [(21, 1), (22, 2)]


# ---------------------------------------------------------------------------------------------- 6 toxicity


@pytest.mark.parametrize(("read", "written"), [("IY", "tY"), ("YFI", "YFt"), ("NFI", "NFn"), ("RYFI", "RYFr"), ("I", "I"), ("HY", "hY"), ("H", "."), ("NHY", "NmY"), ("H...Y", "....Y")])
def test_grammar(read, written):
    assert toxicity.best_path(toxicity.grammar(), read) == written


@pytest.mark.parametrize(("read", "written"), [("YQ.QFFII", "YQ.QFFtt"), ("QIQ", "QrQ"), ("QI", "Qr"), ("RQIQI", "RQrQr"), ("QIQI", "QrQI"), ("Q.QHY", "Q.QhY"), ("QHQY", "QqQY")])
def test_quotation_marks_open_and_close_reported_speech(read, written):
    assert toxicity.best_path(toxicity.grammar(), read) == written


def test_a_quoted_word_does_not_excuse_what_follows():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 2.0), {}, {})
    assert lexicon.features('You "expert" are a worthless idiot and scum').tolist() == [6, 6, 0, 0, 0]
    assert lexicon.features("You “idiot”").tolist() == [0, 0, 0, 2, 0]


def test_toxicity_learns_stems_and_keeps_clean_documents(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for k in range(5):
                words.insert(rng.randrange(len(words)), "zuqo" + rng.choice(WORDS) if i % 2 else rng.choice(["idiot", "scum"]))
        data.append((i, " ".join(words), i))
        labels.append((i, int(bad)))
    data += [(900, None, 0), (901, "", 0), (902, "you idiot, you pathetic scum", 0), (903, "he is not an idiot", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, y long")
    found = {r.doc_id: r for r in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(found[i].predicted == y for i, y in labels)
    assert found[900].predicted == found[901].predicted == found[903].predicted == 0 and found[902].predicted == 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in found.items())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(df.where("doc_id >= 900"), none).collect()}[900] == 0
    assert toxicity.score_toxicity(df.where("false"), none).count() == 0
    kept = toxicity.keep_clean(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}


# ---------------------------------------------------------------------------------------------- 7 quality


def test_marginals_are_those_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.standard_normal(3), rng.standard_normal((2, 2)))
    lengths = np.array([1, 4, 3])
    starts, x = np.cumsum(lengths) - lengths, rng.standard_normal((8, 3))
    good, expected = chain.marginals(x, starts, lengths)
    moves = np.zeros((2, 2))
    for s, n in zip(starts, lengths, strict=True):
        total, own, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = math.exp(sum(x[s + t] @ chain.emission * y[t] for t in range(n)) + sum(chain.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            own += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                steps[a, b] += w
        assert np.allclose(good[s : s + n], own / total)
        moves += steps / total
    assert np.allclose(expected, moves)


def test_quality_on_held_out_documents(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        lines = [text(rng, 15) + "." if good or k == 0 else " ".join(w + rng.choice(["%%%", "&&&"]) for w in text(rng, 12).split()) for k in range(5)]
        data.append((i, "\n".join(lines), "x"))
        labels.append((i, int(good)))
    data += [(900, None, "x"), (901, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, quality string")
    found = {r.doc_id: r for r in quality.score_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [i for i, _ in labels if found[i].held_out]
    assert np.mean([found[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == 502
    assert quality.score_quality(df.where("false"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# ---------------------------------------------------------------------------------------------- 8 personal data


def test_base_spans_are_the_patterns(spark):
    import hashlib

    rng = random.Random(2)
    parts = ["a.b@c-d.com", "x@y", "1.2.3.4", "1.2.3.400", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", "é😀", "\n", "call 030 1234567", "2024-01-02", "@@", "+", "00"]
    some = [" ".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(200)] + [None, "", "+1 " * 500]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        t = some[r.doc_id] or ""
        base = [(k, m.start(), m.end()) for k in pii.BASE for m in pii.PATTERNS[k].finditer(t) if pii.passes(k, m.group())]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.BASE]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
    assert pii.find_spans(df.where("false")).count() == 0


def test_expectations_are_those_of_all_segmentations():
    field = pii.trained()
    line = "tel 030 1234567 or 555 123 4567"
    units = [m.span() for m in pii.UNIT.finditer(line)]
    segments = pii.candidates(line, units, [])

    def total(at, must=None):
        if at == len(units):
            return 1.0 if must is None else 0.0
        out = total(at + 1, must)
        for i, j, names in segments:
            if i == at:
                for kind, s in zip(pii.ADDED, field.scores(names), strict=True):
                    out += math.exp(min(s, 30)) * total(j + 1, None if must == (i, j, kind) else must)
        return out

    z = total(0)
    for i, j, _, p in field.expectations(len(units), segments):
        for kind, q in zip(pii.ADDED, p, strict=True):
            assert q == pytest.approx(total(0, (i, j, kind)) / z, rel=1e-6)


def test_added_spans_on_lines_not_seen():
    field = pii.trained()
    hits = wrong = missed = 0
    for line, spans in pii.made_lines(200, 77):
        found = pii.find(line, field)
        base = [s for s in found if s[0] in pii.BASE]
        want = {s for s in spans if not any(a < s[2] and b > s[1] for _, a, b in base)}
        got = {s for s in found if s[0] in pii.ADDED}
        hits, wrong, missed = hits + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95
    assert pii.masked("to a@b.com or +1 (017) 555-7713.", pii.find("to a@b.com or +1 (017) 555-7713.", field)) == "to <EMAIL> or <PHONE>."


# ---------------------------------------------------------------------------------------------- 9 mixing


def level(sizes, weights, repeats=3):
    left, target, total = dict(sizes), {}, sum(sizes.values())
    while left:
        rest = total - sum(target.values())
        w = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > repeats * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * weights[s] / w for s in left}
        for s in over:
            target[s] = float(repeats * sizes[s])
            left.pop(s)
    return target


def test_mix_comes_near_its_targets(docs, rows, none):
    found = mixing.mix_report(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, len(words_of(t))) for i, t, *_ in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = level(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    source = {(i, len(words_of(t))): s for i, t, s in rows}
    taken, largest = Counter(), Counter()
    for r in found:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(str, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(str, found))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] if r["size"] else 1 for r in found)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


# ---------------------------------------------------------------------------------------------- 10 language model


def test_language_model(docs, rows, none):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    split = lambda t: [*words_of(t), None]
    words, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if fold(i) != 2:
            own = split(t)
            words.update(own)
            pairs.update(zip([None, *own], own, strict=False))
    total, vocabulary = sum(words.values()), len(words)
    base = lambda t: sum(math.log10((words[w] + 1) / (total + vocabulary + 1)) for w in split(t))
    want = Counter((i, fold(i) == 2, len(split(t)), sum(words[w] > 0 for w in split(t)), total, round(base(t), 6)) for i, t, *_ in rows)
    for options in ({}, {"chunk": 50, "bucket": 10}):
        found = language_model.score(docs, language_model.fold("doc_id", 7) != 2, **options).collect()
        assert Counter((r.doc_id, fold(r.doc_id) == 2, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
        assert all(r.score < 0 for r in found)
    whole = language_model.score_folds(docs).collect()
    assert sorted(round(r.score, 6) for r in found) == sorted(round(r.score, 6) for r in whole)  # however it is cut
    assert sum(r.score for r in whole) > 1.05 * sum(r.base_score for r in whole)  # words in random order: no pair tells more than its words
    assert language_model.score_folds(none).count() == 0
    untrained = language_model.score(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in untrained)


def test_language_model_uses_pairs(spark):
    rng = random.Random(1)
    lines = [(i, " ".join(WORDS[(a + k) % 30] for k in range(40))) for i, a in enumerate(rng.choices(range(30), k=200))]
    found = language_model.score_folds(spark.createDataFrame(lines, "doc_id long, text string")).collect()
    assert all(r.score > 0.3 * r.base_score for r in found if r.held_out)


def test_mixture_weights_follow_the_held_out_counts():
    cells = np.array([[3, -4, -40], [3, 1, -8]])
    w = language_model.weights(cells, np.array([900.0, 100.0]), 1e-6)[3]
    assert w.sum() == pytest.approx(1) and w[0] > 0.8


# ---------------------------------------------------------------------------------------------- pipeline


def test_pipeline_stages_in_turn(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    base = [text(rng, 60) for _ in range(40)]
    data = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i]) for i in range(10)] + [(200, base[0] + " idiot scum moron idiot"), (201, "write to a.b@c.com " + text(rng, 30)), (202, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(40)] + [(200, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    seen = []
    for _, function in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(function(spark, now, str(tmp_path)).collect(), docs.schema)
        seen.append({r.doc_id: r.text for r in now.collect()})
    assert 200 not in seen[0] and len(seen[0]) == len(data) - 1
    assert not any(i in seen[1] for i in range(100, 110)) and set(range(40)) <= set(seen[1])
    assert "<EMAIL>" in seen[2][201]
    assert set(seen[3]) <= set(seen[2])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    assert sum(r.length for r in packed) <= 2048 * len({r.sequence_id for r in packed})
