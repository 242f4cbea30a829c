"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes (insult, threat, target, direct address, negation, report, mention, filler), each insult with a weight. Five small
transducers rewrite a clause's classes and are composed into one: mention ("the word idiot", "stupid is a synonym"), negation ("not an
idiot"), reported speech (he said: "..."; it ends with the quotation, or where the speaker turns to the reader: "he said you are ..."),
target (an insult beside whom it is meant for) and threat (a threatening verb with a target). The best path through the composition
says what each clause asserts; a document is the sum over its clauses, scaled by a logistic layer that learns a weight for each kind of
assertion. Before labels are seen only matched clauses count: an insult aimed at no one weighs next to nothing, one that is denied,
reported or only mentioned likewise.

Insults come from fixed lists in four languages, and from the labels: prefixes of words and whole words that stand mostly in toxic documents of
the training sample, by the lower bound of their log-odds. A prefix can count wherever it stands, or only where longer words that begin with it are dense
in the document, as a stem that also turns up by chance. The sample is bounded (SAMPLE labelled rows, those of the smallest hashes), and one document stands for
its near copies, so that their other words aren't learnt. All entries that pass are kept; scoring is one pass over the texts.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, fold, id_text, stage

#: Labelled rows that are learnt from, at most.
SAMPLE = 30_000
#: Lengths of prefixes that can be learnt (longer entries are whole words); a dense one stands twice at least, and once in so many words.
PREFIX, SPARSE = range(3, 11), 160
# Common words of each class, English, German, French and Spanish.
INSULTS = """idiot moron imbecile stupid dumb dumbass fool loser scum trash garbage pathetic worthless disgusting clown jerk bastard bitch
asshole cretin dimwit halfwit pig vermin freak creep filth slut whore retard retarded degenerate subhuman ugly coward scumbag dirtbag
trottel vollidiot dummkopf arschloch hurensohn abschaum versager schwachkopf miststück wichser missgeburt
connard connasse salaud salope abruti débile ordure enculé pourriture minable crétin imbécile
imbécil estúpido estúpida gilipollas cabrón escoria basura asqueroso asquerosa patético patética inútil hijueputa""".split()
THREATS = "kill murder hurt destroy stab shoot strangle beat hang burn rape töte töten umbringen erschlagen tuer tuerai frapper brûler matar mataré matarte golpear".split()
DIRECT = "you your yours yourself u ya du dich dir dein deine ihr euch tu te toi vous votre ton ta tú ti vosotros usted ustedes eres".split()
TARGETS = "he she they him her them his their these those people everyone er sie ihn ihm ihnen diese alle il elle ils elles lui leur ces él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't nor without neither nicht kein keine keiner nie niemals ohne pas jamais sans aucun nunca jamás sin ningún".split()
REPORTS = "said says say saying wrote writes told tells called calls calling claimed quoted quote reported reportedly according sagte sagt schrieb behauptete nannte dit disait écrit écrivit selon dijo dice escribió llamó según".split()
MENTIONS = "word words term terms synonym synonyms noun adjective spelling definition meaning wort wörter begriff begriffe bedeutung mot mots terme termes synonyme palabra palabras término términos sinónimo".split()
FILLERS = "a an the such so very really quite even just at all any be being been is are was were ein eine der die das ist sind so sehr un une le la les est sont très una el los las es son muy".split()
CLAUSE = re.compile(r"[.!?;:\n\r]+")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»]")


# ---------------------------------------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """arcs: state -> input -> [(output, next state, weight)]; an input without an arc of its own takes the arcs of ''."""

    arcs: dict
    start: object
    final: frozenset | None = None  # None: all states

    def steps(self, state: object, symbol: str) -> list[tuple[str, object, float]]:
        own = self.arcs[state]
        return [(symbol if out == "" else out, to, w) for out, to, w in own.get(symbol, own.get("", []))]

    def accepts(self, state: object) -> bool:
        return self.final is None or state in self.final


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` makes of it; weights add up."""
    start = (first.start, second.start)
    arcs: dict = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        arcs[state] = {}
        for symbol in alphabet:
            arcs[state][symbol] = [(out, (a, b), v + w) for middle, a, v in first.steps(state[0], symbol) for out, b, w in second.steps(state[1], middle)]
            todo += [to for _, to, _ in arcs[state][symbol]]
    return Transducer(arcs, start, frozenset(s for s in arcs if first.accepts(s[0]) and second.accepts(s[1])))


def best_path(grammar: Transducer, symbols: str) -> str:
    """What the heaviest accepting path writes; a tie goes to the first arc."""
    reached: dict = {grammar.start: (0.0, "")}
    for symbol in symbols:
        now: dict = {}
        for state, (weight, written) in reached.items():
            for out, to, w in grammar.steps(state, symbol):
                if to not in now or weight + w > now[to][0]:
                    now[to] = (weight + w, written + out)
        reached = now
    return max((x for s, x in reached.items() if grammar.accepts(s)), key=lambda x: x[0], default=(0.0, symbols))[1]


#: Classes read: . other, F filler, M mention, N negation, R report, Q quotation mark, U direct address, Y other target, I insult, H threat.
#: Written besides: x mentioned insult; n, m negated insult, threat; r, q reported ones; t insult with its target, h threat with its target.
ALPHABET = ".FMNRQUYIH"


@functools.cache
def grammar() -> Transducer:
    # m2, m1: just after a mention; h3 to h1: an insult counts as mentioned, so a mention must still follow
    plain = {"I": [("I", "none", 0), ("x", "h3", 0.5)], "M": [("M", "m2", 0)], "": [("", "none", 0)]}
    after = {"I": [("x", "none", 0.5)], "M": [("M", "m2", 0)]}
    hoped = {k: {"F": [("F", f"h{int(k[1]) - 1}", 0)], "M": [("M", "m2", 0)], "": []} for k in ("h3", "h2")}
    mention = Transducer({"none": plain, "m2": after | {"": [("", "m1", 0)]}, "m1": after | {"": [("", "none", 0)]}, **hoped, "h1": {"M": [("M", "m2", 0)], "": []}}, "none", frozenset({"none", "m1", "m2"}))
    negated = {"I": [("n", 0, 0)], "H": [("m", 0, 0)]}
    negation = Transducer({0: {"N": [("N", 2, 0)], "": [("", 0, 0)]}, 2: negated | {"N": [("N", 2, 0)], "F": [("F", 1, 0)], "": [("", 0, 0)]}, 1: negated | {"N": [("N", 2, 0)], "": [("", 0, 0)]}}, 0)
    # 1: after a report, until the reader is addressed; 2: between quotation marks; 3: between those of a report
    told = {k: {"I": [("r", k, 0)], "H": [("q", k, 0)], "": [("", k, 0)]} for k in (1, 2, 3)}
    report = Transducer({0: {"R": [("R", 1, 0)], "Q": [("Q", 2, 0)], "": [("", 0, 0)]}, 1: told[1] | {"U": [("U", 0, 0)], "Q": [("Q", 3, 0)]}, 2: told[2] | {"R": [("R", 3, 0)], "Q": [("Q", 0, 0)]}, 3: told[3] | {"Q": [("Q", 1, 0)]}}, 0)
    # seen: a target stands before; hoped: an insult counts as aimed, so a target must still follow
    met = {c: [(c, "seen", 0)] for c in "UY"}
    target = Transducer({"none": met | {"I": [("I", "none", 0), ("t", "hoped", 1)], "": [("", "none", 0)]}, "seen": {"I": [("t", "seen", 1)], "": [("", "seen", 0)]}, "hoped": met | {"I": [("t", "hoped", 1)], "": [("", "hoped", 0)]}}, "none", frozenset({"none", "seen"}))
    at = {c: [(c, "none", 0)] for c in "UY"}
    threat = Transducer({"none": {"H": [(".", "none", 0), ("h", 3, 1)], "": [("", "none", 0)]}, **{k: at | {"": [("", k - 1, 0)]} for k in (3, 2)}, 1: at | {"": []}}, "none", frozenset({"none"}))
    found = mention
    for following in (negation, report, target, threat):
        found = compose(found, following, ALPHABET)
    return found


#: Sums of what a document's clauses assert that a symbol adds to: insults, of these the aimed ones, denied or only mentioned, reported, threats.
KINDS = {"I": (0,), "t": (0, 1), "n": (2,), "m": (2,), "x": (2,), "r": (3,), "q": (3,), "h": (4,)}
#: The layer before any label is seen: bias, then each kind's sum. Insults aimed at no one add next to nothing.
PRIOR = np.array([-3.0, 0.2, 2.6, 0.1, 0.1, 6.0])


def dense(words: list[str], stems: set[str] | None = None) -> set[str]:
    """Prefixes (of `stems`, or any) with which many longer words of a document begin."""
    counts: Counter = Counter()
    for w in words:
        for k in PREFIX:
            if k < len(w) and (stems is None or w[:k] in stems):
                counts[w[:k]] += 1
    least = max(2, len(words) / SPARSE)
    return {p for p, n in counts.items() if n >= least}


class Lexicon:
    """Insults by word, by prefix of a word, and by stem (a prefix that counts where it is dense), with their weights."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.prefixes, self.stems = words, prefixes, stems
        self.find = ahocorasick.Automaton()
        for w in {*words, *prefixes, *stems, *THREATS}:
            self.find.add_word(w, len(w))
        self.find.make_automaton()
        self.classes = {w: c for c, some in (("F", FILLERS), ("N", NEGATIONS), ("M", MENTIONS), ("R", REPORTS), ("Q", '"“”«»'), ("Y", TARGETS), ("U", DIRECT), ("H", THREATS)) for w in some}

    def weight(self, word: str, active: set[str]) -> float:
        return max([self.words.get(word, 0.0), *(self.prefixes.get(word[:k], 0.0) for k in PREFIX if k <= len(word)), *(self.stems[word[:k]] for k in PREFIX if k < len(word) and word[:k] in active)])

    def features(self, text: str) -> np.ndarray:
        """Summed weights of each kind."""
        out = np.zeros(len(PRIOR) - 1)
        low = text.lower()
        hits = [end - n + 1 for end, n in self.find.iter(low) if end < n or not low[end - n].isalnum()]
        if not hits:
            return out
        active = dense(TOKEN.findall(low), set(self.stems)) if self.stems else set()
        done = -1
        for start in hits:
            if start < done:
                continue
            edge = max((low.rfind(c, 0, start) for c in ".!?;:\n\r"), default=-1) + 1
            after = CLAUSE.search(low, start)
            done = after.start() if after else len(low)
            symbols, weights = [], []
            for token in TOKEN.findall(low, edge, done):
                weight = self.weight(token, active)
                symbols.append("I" if weight else self.classes.get(token, "."))
                weights.append(weight or 1.0)
            if "I" in symbols or "H" in symbols:
                for out_symbol, weight in zip(best_path(grammar(), "".join(symbols)), weights, strict=True):
                    for kind in KINDS.get(out_symbol, ()):
                        out[kind] += weight
        return out


# ---------------------------------------------------------------------------------------------- learning


def family(words: list[str]) -> int:
    """A document's smallest hash of five words in a row: near copies mostly share it."""
    from xxhash import xxh64_intdigest

    return min(xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1


def training_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, limit: int) -> DataFrame:
    """text, y: at most `limit` labelled rows of the training folds, of the smallest hashes; a row that several labels disagree on has the larger."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1)).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = chosen.withColumn("h", F.xxhash64(F.lit("sample"), id_text("doc_id"))).orderBy("h", "doc_id").limit(limit)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").select("text", "y")  # at most `limit` ids


def learnt(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Words, prefixes and stems by the lower bound of their log-odds of toxic documents, where it is high; the sample bounds their number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = TOKEN.findall(text.lower())
                own = {w[:k] for w in set(words) for k in PREFIX if k <= len(w)} | {w + "=" for w in words if len(w) > PREFIX[-1]}
                rows.append((family(words), y, sorted(own | {p + "+" for p in dense(words)})))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["family", "y", "prefixes"])

    documents = sample.mapInArrow(counted, "family long, y int, prefixes array<string>").groupBy("family").agg(F.max_by("prefixes", F.struct("y", F.size("prefixes"), "prefixes")).alias("prefixes"), F.max("y").alias("y"))
    documents = stage(documents, "toxic-sample")
    n = {r.y: r.n for r in documents.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}, {}, {}
    counts = documents.select(F.explode("prefixes").alias("prefix"), "y").groupBy("prefix").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    low = odds - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    stem = F.endswith("prefix", F.lit("+"))
    good = counts.withColumn("low", low).where(F.when(stem, (F.col("a") >= 3) & (F.col("low") >= 2.4)).otherwise((F.col("a") >= 5) & (F.col("low") >= 2.5) & (F.col("b") <= 0.02 * F.col("a"))))
    found = {r.prefix: (r.low, r.a) for r in good.collect()}
    prefixes = nested({p: x for p, x in found.items() if p[-1] not in "+="})
    covered = lambda w: any(w[:k] in prefixes for k in PREFIX)
    stems = nested({p[:-1]: x for p, x in found.items() if p[-1] == "+"})
    words = {p[:-1]: float(x[0]) for p, x in found.items() if p[-1] == "="}
    return {w: x for w, x in words.items() if not covered(w)}, prefixes, {p: x for p, x in stems.items() if not covered(p)}


def nested(good: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of prefixes that begin alike, those that cover most and are most exact."""
    kept: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p), p)):
        shorter = [p[:k] for k in PREFIX if k < len(p) and p[:k] in kept]
        if any(good[q][0] >= good[p][0] - 0.3 and good[p][1] < 0.95 * good[q][1] for q in shorter):
            continue  # a part of what the shorter one covers
        for q in shorter:
            if good[p][1] >= 0.95 * good[q][1]:
                kept.pop(q)  # the longer one covers the same and is more exact
        kept[p] = float(good[p][0])
    return kept


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights near a prior by Newton's method; what toxicity adds is held at 0 or more."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (p - y) + strength * (w - prior))
        w -= np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def shaped(features: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(features), 1)), np.log1p(features)])


def train(sample: DataFrame) -> tuple[Lexicon, np.ndarray]:
    sample = stage(sample, "toxic-texts")
    words, prefixes, stems = learnt(sample)
    lexicon = Lexicon(words | dict.fromkeys(INSULTS, 2.0), prefixes, stems)
    found = sample.mapInArrow(featured(lexicon), "y int, features array<double>")
    # the same features come again and again: rounded, they are few
    rows = found.select("y", F.transform("features", lambda v: F.round(v, 1)).alias("f")).groupBy("y", "f").agg(F.count("*").alias("n")).collect()  # at most SAMPLE rows
    if len({r.y for r in rows}) < 2:
        return lexicon, PRIOR  # one kind alone teaches nothing
    rows.sort(key=lambda r: (r.y, r.f))
    x, y, n = shaped(np.array([r.f for r in rows])), np.array([r.y for r in rows], float), np.array([r.n for r in rows])
    return lexicon, logistic(np.repeat(x, n, axis=0), np.repeat(y, n), PRIOR)


def featured(lexicon: Lexicon):
    entries = (lexicon.words, lexicon.prefixes, lexicon.stems)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*entries)
        for batch in batches:
            features = [own.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(features, pa.list_(pa.float64()))], names=["y", "features"])

    return made


def scored(docs: DataFrame, lexicon: Lexicon, layer: np.ndarray, text: str = "text") -> DataFrame:
    """docs with a column __score; all their columns are kept."""
    entries = (lexicon.words, lexicon.prefixes, lexicon.stems)
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    at = docs.columns.index(text)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*entries)
        for batch in batches:
            features = np.array([own.features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, 5)
            score = 1 / (1 + np.exp(-np.clip(shaped(features) @ layer, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=schema.names)

    return docs.mapInArrow(made, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated ones too.

    Only the text is judged; null counts as empty. Labels are taken from rows whose crc32(doc_id) mod 3 is not 1; null labels are left out, and with
    no labels the fixed list and the layer as it is given decide. No rows give no rows; other columns are left out, whatever their names.
    """
    bound_batches(docs.sparkSession)
    lexicon, layer = train(training_sample(docs, labels, label, text, doc_id, sample))
    found = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), lexicon, layer)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Null and empty texts stay; repeated rows stay or go together; labels as in score_toxicity; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    lexicon, layer = train(training_sample(docs, labels, label, text, doc_id, sample))
    return scored(docs, lexicon, layer, text).where(F.col("__score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
