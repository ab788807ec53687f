"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

The strings that the fixed patterns find are labelled by their kind.  For each kind a prefix tree of
character classes is built from a bounded sample, and states with statistically compatible futures are
merged (Hoeffding bounds) into a probabilistic automaton.  Every candidate token of a text is scored:
the mean log-likelihood of its characters in the best automaton against a model of ordinary words.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.llm.common import batch_texts, below, discard, hash_share, id_and_text, map_rows, materialise, slices

#: The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the automata judge: tokens of the credential alphabet, as long as those that the model of ordinary words is learned from.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
WORD = re.compile(r"[A-Za-z0-9]{8,}")
ORDINARY = "ordinary"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's index, end, the credential itself) of the fixed patterns, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def classes(token: str) -> str:
    """Each character's class: a-f, other lower case, upper case, digit, or the character itself."""
    return token.translate(_CLASSES)


_CLASSES = str.maketrans({**{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
ALPHABET = "hlU9+/_.=-"


@dataclass
class Automaton:
    """next[state][class] = (state, log-likelihood); a class that wasn't seen costs `unseen`."""

    next: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    unseen: float = math.log(1e-3)

    def mean_log_likelihood(self, token: str) -> float:
        state, total, text = 0, 0.0, classes(token)
        for c in text:
            state, cost = self.next[state].get(c, (0, self.unseen)) if self.next else (0, self.unseen)
            total += cost
        return total / max(len(text), 1)


def infer(tokens: list[str], *, alpha: float = 0.05) -> Automaton:
    """Merges the compatible states of the tokens' prefix tree, nearest to the root first.

    Two states are compatible if the shares of ending and of each next class differ by less than their
    Hoeffding bounds, here and after each common class.  Whole tokens build the tree.  No tokens: an
    automaton that finds nothing likely.
    """
    kids: list[dict[str, int]] = [{}]
    count: list[Counter] = [Counter()]  # of next classes; "" ends
    for token in tokens:
        state = 0
        for c in classes(token):
            count[state][c] += 1
            if c not in kids[state]:
                kids[state][c] = len(kids)
                kids.append({})
                count.append(Counter())
            state = kids[state][c]
        count[state][""] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            m, n = count[x].total(), count[y].total()
            if not m or not n:
                continue
            limit = bound * (m**-0.5 + n**-0.5)
            if any(abs(count[x][c] / m - count[y][c] / n) > limit for c in count[x].keys() | count[y].keys()):
                return False
            todo += [(kids[x][c], kids[y][c]) for c in kids[x].keys() & kids[y].keys() if kids[x][c] != kids[y][c]]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            count[x].update(count[y])
            for c, k in kids[y].items():
                if c in kids[x]:
                    if kids[x][c] != k:
                        todo.append((kids[x][c], k))
                else:
                    kids[x][c] = k

    red, blue = [0], [(0, c) for c in sorted(kids[0])]
    while blue:
        parent, c = blue.pop(0)
        state = kids[parent][c]
        if state in red:
            continue
        match = next((r for r in red if alike(r, state)), None)
        if match is None:
            red.append(state)
        else:
            kids[parent][c] = match
            fold(match, state)
        blue = [(r, c) for r in red for c in sorted(kids[r]) if kids[r][c] not in red]
    index = {r: k for k, r in enumerate(red)}
    out = Automaton()
    for r in red:
        total = count[r].total() + len(ALPHABET)
        out.next.append({c: (index[kids[r][c]] if c in kids[r] else 0, math.log((count[r][c] + 1) / total)) for c in ALPHABET})
    return out


@dataclass
class Grammar:
    automata: dict[str, Automaton]
    ordinary: Automaton
    margin: float
    memo: dict[str, tuple[float, str]] = field(default_factory=dict, repr=False, compare=False)  # by the token's classes; starts again when full
    plain: set[str] = field(default_factory=set, repr=False, compare=False)  # tokens that are ordinary; starts again when full

    def score(self, token: str) -> tuple[float, str]:
        """How much likelier a class of the token is in the best automaton than in ordinary text, and that kind."""
        known = classes(token)
        if known not in self.memo:
            plain = self.ordinary.mean_log_likelihood(token)
            if len(self.memo) >= 100_000:
                self.memo.clear()
            self.memo[known] = max(((a.mean_log_likelihood(token) - plain, k) for k, a in self.automata.items()), default=(-math.inf, ""))
        return self.memo[known]

    def likely(self, text: str) -> bool:
        """Whether any candidate of the text scores the margin or more; each distinct candidate is scored."""
        new = set(CANDIDATE.findall(text)).difference(self.plain)
        found = {t for t in new if self.score(t)[0] >= self.margin}
        if len(self.plain) >= 200_000:
            self.plain.clear()
        self.plain.update(t for t in new - found if len(t) <= 64)
        return bool(found)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, sample_tokens: int = 2000, sample_chars: int = 100_000, margin: float = 0.5) -> Grammar:
    """Learns from about sample_docs whole documents, by a hash of the id, in one scan.

    Of each kind of credential, and of ordinary words of eight letters and digits or more, the sample_tokens
    distinct ones with the smallest hashes are learned whole, less those that would bring them to over
    sample_chars characters.  Null ids and texts don't train; nothing to learn from: no span is added.
    """
    rows = id_and_text(docs, id_col, text_col).where("text is not null")
    rows = rows.where(below(hash_share(sample_docs, docs.count()), "doc_id"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, ORDINARY)}
        for batch in slices(batches):
            for text in batch_texts(batch):
                for _, k, _, token in base_spans(text):
                    least[KINDS[k]].setdefault(token, xxhash.xxh64_intdigest(token, 1) >> 1)
                least[ORDINARY].update((w, xxhash.xxh64_intdigest(w, 1) >> 1) for w in set(WORD.findall(text)))
            for kind, found in least.items():
                if len(found) > sample_tokens:
                    least[kind] = {t: found[t] for t in heapq.nsmallest(sample_tokens, found, key=lambda t, found=found: (found[t], t))}
        every = [(kind, h, t) for kind, found in least.items() for t, h in found.items() if len(t) <= sample_chars]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in every], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["kind", "h", "token"])

    distinct = materialise(rows.mapInArrow(tokens, "kind string, h long, token string").distinct(), "labelled-tokens")
    got: dict[str, list[str]] = {}
    for kind in (*KINDS, ORDINARY):
        got[kind], room = [], sample_chars
        for r in distinct.where(F.col("kind") == kind).orderBy("h", "token").limit(sample_tokens).collect():
            if len(r.token) <= room:
                got[kind].append(r.token)
                room -= len(r.token)
    discard(distinct)
    return Grammar({k: infer(got[k]) for k in KINDS if got[k]}, infer(got[ORDINARY]), margin)


def all_spans(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and (start, end, kind) of candidates that an automaton finds likelier than ordinary text by the margin.

    Every candidate is scored, letters or digits alone too, unless a base span covers all of it.
    """
    base = base_spans(text)
    more = []
    if grammar.likely(text):
        for m in CANDIDATE.finditer(text):
            gain, kind = grammar.score(m[0])
            if gain >= grammar.margin and not any(s <= m.start() and m.end() <= e for s, _, e, _ in base):
                more.append((m.start(), m.end(), f"like_{kind}"))
    return base, more


def scan(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text; null as empty.

    Spans read kind:start:end in code points, end exclusive, sorted by start, then kind as listed (added
    kinds, like_..., last), joined by commas.  Rows that repeat are scanned each.
    """
    share = docs.sparkSession.sparkContext.broadcast(grammar)  # as large as the training sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch_texts(batch):
                base, more = all_spans(text, share.value)
                n = Counter(k for _, k, _, _ in base)
                first = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                every = sorted([(s, k, e, KINDS[k]) for s, k, e, _ in base] + [(s, len(KINDS), e, k) for s, e, k in more])
                rows.append((n[0], n[1], n[2], hashlib.sha256(first.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, _, e, k in every)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, grammar: Grammar, *, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by the mask (overlapping spans by one), and chars_col, if there, set to the new length.

    All rows stay; null texts stay null, empty ones empty.  Texts are masked whole, however long.
    """
    share = docs.sparkSession.sparkContext.broadcast(grammar)
    names = docs.columns
    at, n_at = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            out, cols = [], list(batch.columns)
            for text in batch.column(at).to_pylist():
                if text:
                    base, more = all_spans(text, share.value)
                    merged: list[list[int]] = []
                    for s, e in sorted([(s, e) for s, _, e, _ in base] + [(s, e) for s, e, _ in more]):
                        if merged and s < merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                    for s, e in reversed(merged):
                        text = text[:s] + mask + text[e:]
                out.append(text)
            cols[at] = pa.array(out, pa.string())
            if n_at is not None:
                old = cols[n_at].to_pylist()
                cols[n_at] = pa.array([o if t is None else len(t) for o, t in zip(old, out, strict=True)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_rows(docs, run)
