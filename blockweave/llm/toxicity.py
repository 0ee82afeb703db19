"""Toxicity by a weighted finite-state pattern grammar (operator 7)."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import dropped, released, sliced, written

#: Labelled texts that learning reads at most of either label, chosen by a hash of doc_id.
POSITIVES, NEGATIVES = 2000, 6000
#: Toxic texts, near copies left out, that must hold a learned insult.
SUPPORT = 8
#: Forms that a task holds before it gives their counts on.
HELD = 50_000
#: Share of its texts that are toxic, from which a form is an insult. Other forms are mild ones where a toxic text
#: holds so many times more of them, a word, than a clean one.
PURITY, LIFT = 0.95, 12.0
STEMS = range(3, 9)
THRESHOLD = 0.7
TARGETS = frozenset("you your yours he she they him her them tu vous toi votre ton du dich dein ihr sie usted tú vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't pas jamais nicht kein keine nie nunca jamás".split())
REPORTING = frozenset("said says claimed called reported wrote quoted dit déclare sagte schrieb dijo afirmó".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn tuer frapper töten schlagen matar golpear".split())
SCOPE = 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?;\n]")
#: What the lexicon makes of words, and what the composed machine puts out.
SYMBOLS = ("other", "insult", "mild insult", "threat", "target", "denial", "report")
OUTPUTS = ("insult", "aimed insult", "negated insult", "reported insult", "mild insult", "threat")
#: Of a text: the logarithm of the distinct words that left by each output and how thick they stand; and, as mild words
#: are met by chance the more the longer a text is, their number, and its length (as a loss) if it has any.
FEATURES = (*OUTPUTS, "density", "mild words", "length")


@dataclass(frozen=True)
class Machine:
    """A weighted transducer: by state its arcs (input, output, weight, next state), an output "" being none, and
    the states that may end a clause."""

    start: object
    arcs: dict
    final: frozenset


def machine(start, final, rules: list[tuple], alphabet: tuple[str, ...]) -> Machine:
    """From rules (state, input, output, weight, next). Symbols of the alphabet without a rule in a state pass by
    the state's rule for "*", whose output "*" is the symbol itself; without such a rule they have no arc."""
    arcs: dict = {}
    for state in {r[0] for r in rules} | {r[4] for r in rules}:
        own = [r for r in rules if r[0] == state]
        named = {r[1] for r in own}
        arcs[state] = [(i, o, w, n) for _, i, o, w, n in own if i != "*"]
        arcs[state] += [(x, x if o == "*" else o, w, n) for _, i, o, w, n in own if i == "*" for x in alphabet if x not in named]
    return Machine(start, arcs, frozenset(final))


def compose(a: Machine, b: Machine) -> Machine:
    """The machine that feeds what `a` puts out to `b`: pairs of states that can be reached, weights added."""
    start, arcs, todo = (a.start, b.start), {}, [(a.start, b.start)]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        arcs[state] = []
        for i, o, w, n in a.arcs[state[0]]:
            arcs[state] += [(i, o2, w + w2, (n, n2)) for i2, o2, w2, n2 in b.arcs[state[1]] if i2 == o] if o else [(i, "", w, (n, state[1]))]
        todo += [x[3] for x in arcs[state]]
    return Machine(start, arcs, frozenset(s for s in arcs if s[0] in a.final and s[1] in b.final))


def negation(scope: int = SCOPE) -> Machine:
    """A denial word opens a scope of so many words, in which insults are negated and the rest says nothing."""
    rules = []
    for k in range(scope + 1):
        inside = (("insult", "negated insult"), ("mild insult", "other"), ("threat", "other")) if k else ()
        rules += [(k, x, y, 0.0, max(0, k - 1)) for x, y in (*inside, ("*", "*"))]
    return machine(0, range(scope + 1), rules + [(k, "denial", "other", 0.0, scope) for k in range(scope + 1)], SYMBOLS)


def reported() -> Machine:
    """After a reporting verb, insults up to the clause's end are someone else's."""
    rules = [("own", "report", "other", 0.0, "told"), ("own", "*", "*", 0.0, "own"), ("told", "insult", "reported insult", 0.0, "told"), ("told", "mild insult", "other", 0.0, "told"), ("told", "report", "other", 0.0, "told"), ("told", "*", "*", 0.0, "told")]
    return machine("own", ("own", "told"), rules, (*SYMBOLS, *OUTPUTS))


def threats(scope: int = SCOPE) -> Machine:
    """A threat counts if a target follows within so many words: the machine supposes so, and drops the supposition
    where it fails; or it takes the word for another one."""
    rules = [(0, "threat", "threat", 0.0, scope), (0, "threat", "other", 0.0, 0), (0, "*", "*", 0.0, 0)]
    for k in range(1, scope + 1):
        rules += [(k, "target", "target", 0.0, 0), *([(k, x, y, 0.0, k - 1) for x, y in (("threat", "other"), ("*", "*"))] if k > 1 else [])]
    return machine(0, (0,), rules, (*SYMBOLS, *OUTPUTS))


def targets() -> Machine:
    """Insults of a clause that names a target, before or after, are aimed: the machine supposes at the start
    that there is one, or none, and only what turns out true may end."""
    rules = [("start", "target", "", 0.0, "met"), ("met", "target", "", 0.0, "met"), ("hoped", "target", "", 0.0, "met")]
    for state, steps in (("start", ("hoped", "none")), ("hoped", ("hoped",)), ("none", ("none",)), ("met", ("met",))):
        for then in steps:
            rules += [(state, "insult", "insult" if then == "none" else "aimed insult", 0.0, then), (state, "*", "*", 0.0, then)]
    return machine("start", ("start", "none", "met"), rules, tuple(x for x in (*SYMBOLS, *OUTPUTS) if x != "target"))


def weighing(weights: tuple[float, ...]) -> Machine:
    """One state that puts out what counts, with its weight, and nothing for the rest."""
    return machine("all", ("all",), [("all", x, x, float(w), "all") for x, w in zip(OUTPUTS, weights, strict=True)] + [("all", "*", "", 0.0, "all")], (*SYMBOLS, *OUTPUTS))


@lru_cache(8)
def grammar(weights: tuple[float, ...] = (1.0,) * len(OUTPUTS)) -> Machine:
    """The composition of all machines."""
    out = negation()
    for then in (reported(), threats(), targets(), weighing(weights)):
        out = compose(out, then)
    return out


def best_path(m: Machine, symbols: tuple[str, ...]) -> tuple[float, tuple[tuple[int, str], ...]] | None:
    """Weight and outputs, each with the place of its word, of the heaviest path that reads a whole clause; of equal
    ones the first by the order of arcs."""
    at: dict = {m.start: (0.0, None)}
    for i, x in enumerate(symbols):
        then: dict = {}
        for state, (weight, out) in at.items():
            for inp, o, w, n in m.arcs[state]:
                if inp == x and (n not in then or weight + w > then[n][0]):
                    then[n] = (weight + w, (out, i, o) if o else out)
        at = then
    found = max((v for s, v in at.items() if s in m.final), key=lambda v: v[0], default=None)
    if found is None:
        return None
    out, link = [], found[1]
    while link:
        link, i, o = link
        out.append((i, o))
    return found[0], tuple(reversed(out))


#: Clauses up to so many symbols are remembered.
SHORT = 48


@lru_cache(1 << 13)
def _remembered(symbols: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    return best_path(grammar(), symbols)[1]


def _outputs(symbols: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    return _remembered(symbols) if len(symbols) <= SHORT else best_path(grammar(), symbols)[1]


@dataclass(frozen=True)
class Grammar:
    """Learned insults (words and stems), milder ones that clean texts hold too, and the features' weights."""

    words: frozenset = frozenset()
    stems: tuple = ()
    mild_words: frozenset = frozenset()
    mild_stems: tuple = ()
    weights: tuple = (0.0,) * len(FEATURES)
    bias: float = 0.0
    trigger: re.Pattern | None = field(default=None, compare=False)

    def with_trigger(self) -> Grammar:
        stems = "|".join(map(re.escape, sorted({*self.words, *self.stems, *self.mild_words, *self.mild_stems}, key=lambda x: (-len(x), x))))
        threats = "|".join(sorted(THREATS))
        return replace(self, trigger=re.compile(rf"\b(?:{stems}|{threats})" if stems else rf"\b(?:{threats})"))

    def symbol(self, word: str) -> str:
        """The lexicon's machine of one state."""
        if word in self.words or self.stems and word.startswith(self.stems):
            return "insult"
        if word in self.mild_words or self.mild_stems and word.startswith(self.mild_stems):
            return "mild insult"
        return "threat" if word in THREATS else "target" if word in TARGETS else "denial" if word in NEGATIONS else "report" if word in REPORTING else "other"


def clause_outputs(tokens: list[str], g: Grammar) -> list[tuple[str, str]]:
    """(output, word) of one clause. Of longer runs of other words SCOPE + 1 are read, as no scope is longer."""
    symbols = [g.symbol(t) for t in tokens]
    keep = [i for i, x in enumerate(symbols) if x != "other" or any(y != "other" for y in symbols[max(0, i - SCOPE - 1) : i])]
    return [(o, tokens[keep[i]]) for i, o in _outputs(tuple(symbols[i] for i in keep))]


def matched(text: str, g: Grammar) -> dict[str, Counter]:
    """The words that leave by each output. Only clauses that hold a trigger are read, each once."""
    low, found, end = text.lower(), defaultdict(Counter), 0
    for m in g.trigger.finditer(low):
        if m.start() < end:
            continue
        begin = max(low.rfind(c, 0, m.start()) for c in ".!?;\n") + 1
        stop = _END.search(low, m.end())
        end = stop.start() if stop else len(low)
        for o, word in clause_outputs(_WORD.findall(low, begin, end), g):
            found[o][word] += 1
    return found


def features(text: str, g: Grammar) -> np.ndarray:
    found = matched(text, g)
    n, mild = [len(found[o]) for o in OUTPUTS], len(found["mild insult"])
    thick = mild + sum(sum(found[o].values()) for o in OUTPUTS if o != "mild insult")
    return np.array([*np.log1p(n), np.log1p(1000 * thick / max(50, len(text))), mild, -len(text) / 1000 if mild else 0], float)


def score(x: np.ndarray, g: Grammar) -> float:
    return float(1 / (1 + np.exp(-np.clip(x @ np.array(g.weights) + g.bias, -30, 30))))


def _forms(text: str) -> Counter:
    """Words and stems, each with the number of distinct words that it stands for; "" for all of them."""
    words = set(_WORD.findall(text.lower()))
    return Counter(f for w in words for f in ("", w, *(w[:k] + "*" for k in STEMS if len(w) > k)))


def signs(text: str) -> list[int]:
    """Four smallest word hashes, each under its own seed; longer words only, where there are any."""
    words = {w.encode() for w in _WORD.findall(text.lower())}
    words = {w for w in words if len(w) > 5} or words
    return [min((zlib.crc32(w, k) for w in words), default=0) for k in (1, 2, 3, 4)]


def apart(marks: list[tuple[int, list[int]]]) -> frozenset[int]:
    """Ids of one of each group of near copies: a text is left out if two of its signs were met together."""
    met: set[tuple] = set()
    out = set()
    for doc, four in marks:
        pairs = set(combinations(enumerate(four), 2))
        if not pairs & met:
            out.add(doc)
        met |= pairs
    return frozenset(out)


def share_toxic(n: int, n_toxic: int, misses: int, n_clean: int, rate: float) -> float:
    """Of the texts with a form, about the share that is toxic, at this rate of toxic texts."""
    hits = n / max(1, n_toxic) * rate
    return hits / (hits + (misses + 0.1) / max(1, n_clean) * (1 - rate))


def chosen(forms: list[str], held: Counter, clean: Counter) -> list[str]:
    """Of forms that stand for much the same words some: a stem gives way to its longest continuation that nearly as
    many texts hold, is taken where it has clearly more texts than any word or longer stem of it, and then stands
    for all of them."""
    kept = set(forms)
    for f in forms:
        if f[-1] == "*":
            longest = max((g for g in forms if g[-1] == "*" and g.startswith(f[:-1]) and held[g] >= 0.95 * held[f]), key=len)
            if longest != f:
                kept.discard(f)
    out: list[str] = []
    for f in sorted(kept, key=lambda f: (clean[f] > 0, -held[f], f[-1] == "*", -len(f), f)):
        covered = any(g[-1] == "*" and f.startswith(g[:-1]) for g in out)
        same = f[-1] == "*" and any(g.startswith(f[:-1]) and held[g] >= 0.9 * held[f] for g in out)
        if not covered and not same:
            out.append(f)
    return out


def lexicon(toxic: Counter, clean: Counter, toxic_words: Counter, clean_words: Counter, n_toxic: int, n_clean: int, rate: float) -> tuple[list[str], list[str]]:
    """Insults and mild insults among forms by the toxic and clean texts that hold them, and by the words that they
    stand for in these ("": all words)."""
    common = [f for f, n in toxic.items() if f and n >= SUPPORT]
    pure = [f for f in common if share_toxic(toxic[f], n_toxic, clean[f], n_clean, rate) >= PURITY]
    strong = chosen(pure, toxic, clean)

    def lift(f: str) -> float:
        return (toxic_words[f] / max(1, toxic_words[""])) / ((clean_words[f] + 0.5) / max(1, clean_words[""]))

    left = [f for f in common if lift(f) >= LIFT and not any(f == g or g[-1] == "*" and f.startswith(g[:-1]) for g in strong)]
    # What a stem's pure words don't explain: stems that an insult begins with are as common as that insult.
    left = [f for f in left if not (f[-1] == "*" and any(g.startswith(f[:-1]) and toxic[g] >= 0.8 * toxic[f] for g in strong))]
    out: list[str] = []
    for f in sorted(left, key=lambda f: (-toxic[f] * np.log(lift(f)), len(f), f)):
        if not any(f.startswith(g.rstrip("*")) or g.startswith(f.rstrip("*")) for g in out):
            out.append(f)
    return strong, out


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with weights of 0 or more. A few texts of either kind stand for the prior: they keep
    every weight finite and of the right sign."""
    prior = [(1, np.eye(len(FEATURES))[i] * np.log(2)) for i in (0, 1, 2, 3, 5)] * 4 + [(0, np.zeros(len(FEATURES)))] * 8
    y = np.concatenate((y, [p for p, _ in prior]))
    x = np.concatenate((x.reshape(-1, len(FEATURES)), [v for _, v in prior]))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w, b = x / scale, np.zeros(x.shape[1]), 0.0
    for _ in range(6000):
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w = np.maximum(w - 4.0 * (x.T @ d / len(y) + 1e-5 * w), 0)
        b -= 4.0 * d.mean()
    return w / scale, float(b)


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Grammar:
    """The grammar from texts (doc_id, text) and labels (doc_id, toxic; 0 or 1). At most so many texts of either
    label are read, the first by a hash of doc_id; those ids, whose number is bounded, are broadcast to the
    texts. Without toxic texts nothing is learned and every score is that of no match. The classes of targets,
    denials, reporting verbs and threats are closed and given; insults and all weights are learned."""
    some = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    first = some.where("y = 1").orderBy("h", "doc_id").limit(positives).unionByName(some.where("y = 0").orderBy("h", "doc_id").limit(negatives)).select("doc_id", "y")
    sample = written(docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(first), "doc_id"), "sample")
    texts = sample.select("doc_id", "text", "y").dropDuplicates(["doc_id"])

    def signs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([signs(x) for x in b.column("text").to_pylist()], pa.list_(pa.int64()))], ["doc_id", "signs"])

    def counts(rows: DataFrame, keep: frozenset | None, among: frozenset | None) -> tuple[Counter, Counter]:
        """Texts that hold each form, and distinct words that it stands for in them, over the kept texts."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, words = Counter(), Counter()

            def settled() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([words[f] for f in held], pa.int64())], ["f", "n", "w"])
                held.clear()
                words.clear()
                return out

            for b in sliced(batches):
                for doc, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    if keep is None or doc in keep:
                        for f, n in _forms(x).items():
                            if among is None or f in among:
                                held[f] += 1
                                words[f] += n
                    if len(held) > HELD:
                        yield settled()
            yield settled()

        found = rows.select("doc_id", "text").mapInArrow(released(counted), "f string, n long, w long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        found = found.where(f"n >= {SUPPORT} OR f = ''" if among is None else "true").collect()
        return Counter({r["f"]: r["n"] for r in found}), Counter({r["f"]: r["w"] for r in found})

    bad = texts.where("y = 1")
    keep = apart([(r["doc_id"], r["signs"]) for r in bad.select("doc_id", "text").mapInArrow(released(signs_of), "doc_id long, signs array<long>").orderBy("doc_id").collect()])
    toxic, toxic_words = counts(bad, keep, None)
    clean, clean_words = counts(texts.where("y = 0"), None, frozenset(toxic)) if toxic else (Counter(), Counter())
    n = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pure, mild = lexicon(toxic, clean, toxic_words, clean_words, len(keep), min(negatives, n.get(0, 0)), n.get(1, 0) / max(1, sum(n.values())))

    def split(forms: list[str]) -> tuple[frozenset, tuple]:
        return frozenset(f for f in forms if f[-1] != "*"), tuple(f[:-1] for f in forms if f[-1] == "*")

    g = Grammar(*split(pure), *split(mild)).with_trigger()

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), pa.array([list(features(x, g)) for x in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.mapInArrow(released(outputs), "y int, x array<double>").collect()
    w, b = fitted(np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float))
    dropped(sample)
    return replace(g, weights=tuple(w), bias=b)


def rate(docs: DataFrame, g: Grammar) -> DataFrame:
    """doc_id, score, predicted, matched (clause outputs) of every whole text; null and empty texts match
    nothing. Rows that repeat a doc_id each get their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            xs = [features(x or "", g) for x in b.column("text").to_pylist()]
            s = [score(x, g) for x in xs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32()), pa.array([[f for f, v in zip(OUTPUTS, x, strict=False) if v] for x in xs], pa.list_(pa.string()))], ["doc_id", "score", "predicted", "matched"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, score double, predicted int, matched array<string>")


def clean(docs: DataFrame, g: Grammar) -> DataFrame:
    """The rows of `docs`, all columns, that the grammar does not predict as toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array([score(features(x or "", g), g) < THRESHOLD for x in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
