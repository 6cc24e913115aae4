"""Personal data: exact base patterns, and a skip-chain conditional random field that makes labels consistent.

Base spans come from four patterns (email, ip, card with a Luhn check, phone) and always stay. In every text a
conditional random field over its candidate tokens (those with a digit or an '@', and other spellings of base spans)
looks for further mentions. Neighbouring candidates share a chain potential. Repeated or similar tokens, however far
apart, share a skip potential that favours one label: a run of tokens whose letters and digits are those of a base span
(a phone's also without its country code) is tied to that span, other repeats to the first of them. Loopy sum-product
message passing runs over the whole text until no message moves by more than 1e-4, or for ROUNDS rounds; ties are stars,
so a label reaches its repeats in two. Base labels are certain, however many repeats there are. A token outside base spans is added where its posterior reaches SURE. Evidence of
a token's shape alone stays below even odds, so only agreement adds a span; where a token is tied to a base span, its
shape may speak against it by FLOOR at most, so that agreement can win. A run of candidates can agree by its chain
potentials alone, so texts without base spans are inferred too; only a text without a candidate token needs no messages.

Potentials are fitted in closed form (piecewise) to the base labels of a sample of at most `sample` expected documents.
For the skip potential each base span that has an earlier one of equal key is masked, and it is counted how often that
one's label is right; AGREE is counted before any table is seen.

Nulls, ties and repeats: a null text has no spans and stays null; a null id keeps its row; spans are sorted by kind, then
start; every row has a result, of its whole text. An empty table gives no rows. Other columns are not read (redaction
passes them through).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import released, slices, texts

KINDS = ("email", "ip", "card", "phone")
SURE, ROUNDS, DAMP, SHAPE_CAP, FLOOR, CERTAIN = 0.8, 100, 0.3, -1.0, -1.5, 1e9
#: Prior counts of repeats that are something else, and that are personal data too.
AGREE = (1.0, 200.0)
#: A mention's tokens at most, and the least digits by which a number is taken for a repeat.
REACH, LEAST_DIGITS = 8, 7

Span = tuple[int, int, int]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its first digit only: from a later one the pattern would fail in the same place.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
PLAIN = re.compile(r"[^0-9A-Za-z]+")
SPELT = re.compile(r"[\[({<]\s?(?:at|dot)\s?[\])}>]", re.IGNORECASE)
EDGES = ".,;:!?\"'()[]<>{}#*$%&|"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), leftmost and non-overlapping within a kind, in code points."""
    found: list[Span] = []
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _shape(token: str) -> str:
    digits = sum(c.isdigit() for c in token)
    size = next(i for i, top in enumerate((0, 3, 7, 11, 15, 19, 1 << 60)) if digits <= top)
    return f"{size}{'@' in token:d}{'+' in token:d}{'.' in token[1:-1]:d}{'-' in token:d}{any(c.isalpha() for c in token):d}"


def _plain(text: str) -> str:
    """Letters and digits alone; a bracketed "at" or "dot" stands for its sign."""
    return PLAIN.sub("", SPELT.sub("", text)).lower()


def _key(text: str) -> str:
    """Texts are similar if their letters and digits agree; short ones say too little."""
    plain = _plain(text)
    return plain if len(plain) >= (LEAST_DIGITS if plain.isdigit() else 4) else ""


def _forms(kind: int, key: str) -> list[str]:
    """The keys under which a base span may be repeated."""
    national = [key[n:] for n in (1, 2, 3)] if KINDS[kind] == "phone" else []
    return [key, *(f"{zero}{x}" for x in national if len(x) > LEAST_DIGITS for zero in ("", "0"))]


def _ties(words: list[str], label: list[int], hubs: dict[str, int]) -> dict[int, int]:
    """Token -> the base span's token it repeats: runs of unlabelled tokens that spell a base span's key."""
    begun = {key[:n] for key in hubs for n in range(len(key) + 1)}
    ties: dict[int, int] = {}
    at = 0
    while at < len(words):
        joined, last, hub = "", at, None
        for j in range(at, min(at + REACH, len(words))):
            plain = "" if label[j] else _plain(words[j])
            joined += plain
            if label[j] or not joined or joined not in begun:
                break
            if plain and joined in hubs:
                last, hub = j, hubs[joined]
        if hub is not None:
            ties.update((j, hub) for j in range(at, last + 1))
        at = last + 1
    return ties


class Graph:
    """Candidate tokens of one text with their base labels, chain edges and skip edges; a tied token's shape begins with '='."""

    def __init__(self, text: str, spans: list[Span]) -> None:
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in tokens]
        label = [0] * len(tokens)
        starts = np.array([t[0] for t in tokens], np.int64)
        hubs: dict[str, int] = {}
        for kind, start, end in spans:
            first = max(int(np.searchsorted(starts, start, "right")) - 1, 0)
            for i in range(first, int(np.searchsorted(starts, end, "left"))):
                if tokens[i][1] > start:
                    label[i] = kind + 1
            if key := _key(text[start:end]):
                for form in _forms(kind, key):
                    hubs.setdefault(form, first)
        ties = _ties(words, label, hubs) if hubs else {}
        self.at, self.where, self.labels, self.shapes = [], [], [], []
        self.chain: list[tuple[int, int]] = []
        node: dict[int, int] = {}
        repeats: list[tuple[int, int]] = []
        seen: dict[str, int] = {}
        for i, (word, y) in enumerate(zip(words, label, strict=True)):
            if not (y or i in ties or "@" in word or any(map(str.isdigit, word))):
                continue
            n = node[i] = len(self.at)
            if n and self.at[-1] == i - 1:
                self.chain.append((n - 1, n))
            if not y and i not in ties and (key := _key(word)):
                if seen.setdefault(key, n) != n:
                    repeats.append((seen[key], n))
            self.at.append(i)
            self.where.append(tokens[i])
            self.labels.append(y)
            self.shapes.append(("=" if i in ties else "") + _shape(word))
        self.skip = [(node[hub], node[i]) for i, hub in ties.items()] + repeats


def repeats_of(text: str, spans: list[Span]) -> Counter:
    """How often a base span's kind is (True) and is not (False) that of the first base span of its key."""
    first: dict[str, int] = {}
    agreed: Counter = Counter()
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if key := _key(text[a:b]):
            if key in first:
                agreed[first[key] == kind] += 1
            first.setdefault(key, kind)
    return agreed


class Field:
    """Potentials: unary by shape, chain by label pair, and one for the agreement of similar tokens."""

    def __init__(self, counts: dict[tuple[str, str, str], int]) -> None:
        k = len(KINDS) + 1
        shapes: dict[str, np.ndarray] = {}
        pairs, agree = np.ones((k, k)), list(AGREE)
        for (what, a, b), n in counts.items():
            if what == "shape":
                shapes.setdefault(a, np.full(k, 0.5))[int(b)] += n
            elif what == "chain":
                pairs[int(a), int(b)] += n
            else:
                agree[int(a)] += n
        self.unary = {s: np.minimum(np.log(v / v[0]), np.where(np.arange(k) > 0, SHAPE_CAP, 0.0)) for s, v in shapes.items()}
        self.unary |= {"=" + s: np.maximum(v, FLOOR) for s, v in self.unary.items()}
        self.rest = np.where(np.arange(k) > 0, FLOOR, 0.0)
        p = pairs / pairs.sum()
        self.chain = np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0))), -2.0, 2.0)
        self.skip = np.eye(k) * float(np.clip(np.log(agree[1] / agree[0]), 0.5, 6.0))

    def posterior(self, graph: Graph) -> np.ndarray:
        k, n = len(KINDS) + 1, len(graph.at)
        unary = np.array([self.unary.get(s, self.rest) for s in graph.shapes]).reshape(n, k)
        for i, y in enumerate(graph.labels):
            if y:
                unary[i] = np.where(np.arange(k) == y, 0.0, -CERTAIN)
        edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
        if not len(edges):
            belief = unary
        else:
            table = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            tables = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            sent = np.zeros((2 * len(edges), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, sent)
                into = (belief[source] - sent[back])[:, :, None] + tables
                top = into.max(axis=1)
                new = top + np.log(np.exp(into - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                moved, sent = np.abs(new - sent).max(), DAMP * sent + (1 - DAMP) * new
                if moved < 1e-4:
                    break
            belief = unary.copy()
            np.add.at(belief, target, sent)
        odds = np.exp(belief - belief.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Base spans and those that the field adds, by kind and start."""
        if not (base or "@" in text or any(map(str.isdigit, text))):
            return []
        graph = Graph(text, base)
        chance = self.posterior(graph)
        best = chance.argmax(axis=1)
        added: list[Span] = []
        before = (-2, 0)
        for i, y in enumerate(best.tolist()):
            if not y or graph.labels[i] or chance[i, y] < SURE:
                continue
            a, b = graph.where[i]
            while a < b and text[a] in EDGES:
                a += 1
            while b > a and text[b - 1] in EDGES:
                b -= 1
            if a == b:
                continue
            if before == (graph.at[i] - 1, y):
                added[-1] = (y - 1, added[-1][1], b)
            else:
                added.append((y - 1, a, b))
            before = (graph.at[i], y)
        return sorted([*base, *added])


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit_field(docs: DataFrame, sample: int = 5000) -> Field:
    """Potentials from the base labels of about `sample` documents, chosen by a hash of the text."""
    total = docs.count()
    share = min(1.0, sample / max(total, 1))
    drawn = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit("field")), F.lit(1 << 20)) < share * (1 << 20))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 16):
            seen: Counter = Counter()
            for text in texts(batch.column(0)):
                base = base_spans(text)
                graph = Graph(text, base)
                seen.update(("shape", s.lstrip("="), str(y)) for s, y in zip(graph.shapes, graph.labels, strict=True))
                seen.update(("chain", str(graph.labels[a]), str(graph.labels[b])) for a, b in graph.chain)
                seen.update({("skip", str(int(same)), ""): n for same, n in repeats_of(text, base).items()})
            rows = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["what", "a", "b", "n"])

    sums = drawn.mapInArrow(released(counted), "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Field({(r["what"], r["a"], r["b"]): r["n"] for r in sums})


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in slices(batches, 4096, 16):
            rows = []
            for text in texts(batch.column(1)):
                base = base_spans(text)
                spans = field.spans(text, base)
                per = Counter(k for k, _, _ in base)
                rows.append((*(per[k] for k in range(4)), hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans), len(spans) - len(base), len(spans)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(found), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with personal data in `text` replaced; a column n_chars follows the new text; null texts stay null."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 16):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            new = [None if t is None else masked(t, field.spans(t, base_spans(t))) for t in columns["text"].to_pylist()]
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(released(cleaned), docs.schema)


def op9_pii(docs: DataFrame) -> DataFrame:
    return find(docs, fit_field(docs))
