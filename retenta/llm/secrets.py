"""Secret scans: fixed patterns, and random-looking strings by two character Markov models.

The fixed patterns give spans of kinds assign, access and hex. Further tokens count as
secrets (kind ``random``) if a first-order character model of random strings explains them
better than one of ordinary identifiers, by log-likelihood ratio per character. Both models
are trained from labelled samples of the corpus at hand: what the fixed patterns matched is
random, all other tokens are ordinary. Character pairs are counted in the tasks of Spark;
the driver sees two tables of at most 67 x 67 counts.

Nulls and ties: a null text is an empty one and has no spans; repeated rows are scanned each
for itself; a null id is kept. Without a pattern match in the sample the random model is
uniform; an empty table gives no rows. Other columns are left as they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T

# The patterns, the group whose length counts, and that length.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"(?=[PpSsTtAa])(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_CHARS, ACCESS, HEX = 6, r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
# End of fixed values.

#: Documents that the models are trained on, about; a bound and not a share, so it stays at any size.
SAMPLE_DOCS = 5_000
#: Tokens that are compared, the least letters-and-digits length, and the least ratio in bits a character.
TOKEN, LEAST_BITS = r"[A-Za-z0-9+/_=]{20,}", 1.0
ORDINARY = r"[A-Za-z0-9+/_=]{3,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
_N = len(ALPHABET) + 1  # the last state is the start of a token


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost matches of each kind that don't overlap.

    For access and hex the whole run is taken from its first place, so asking for the
    length within the pattern finds the same spans as dropping short matches.
    """
    found = []
    if ":" in text or "=" in text:  # one of them is in every match
        for m in _compiled("assign").finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in _compiled("access").finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _compiled("hex").finditer(text)]
    return sorted(found)


def _compiled(name: str) -> re.Pattern:
    store = T.worker_store()
    if ("secret", name) not in store:
        patterns = {"assign": (ASSIGN, re.I | re.A), "access": (ACCESS, 0), "hex": (HEX, 0), "token": (TOKEN, 0), "ordinary": (ORDINARY, 0)}
        store["secret", name] = re.compile(*patterns[name])
    return store["secret", name]


def _states() -> np.ndarray:
    table = np.full(128, -1, np.int64)
    table[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    return table


def _pairs(tokens: list[str]) -> np.ndarray:
    """State pairs (previous * N + next) of all tokens, each from the start state."""
    if not tokens:
        return np.zeros(0, np.int64)
    states = np.append(_states(), _N - 1)
    raw = np.frombuffer(("\x00" + "\x00".join(tokens)).encode(), np.uint8)
    own = np.where(raw == 0, _N - 1, states[np.minimum(raw, 127)])
    return (own[:-1] * _N + own[1:])[own[1:] != _N - 1]


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Ratio in bits of each state pair, random against ordinary, from about ``sample_docs`` documents."""
    n = docs.count()
    sample = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    if n > sample_docs:
        sample = sample.filter(
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int((1 << 40) * sample_docs / n))
        )

    def count(batches):
        seen = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans, rest, at = base_spans(text), [], 0
                values = []
                for start, kind, end in spans:
                    if start >= at:
                        rest.append(text[at:start])
                    own = text[start:end]
                    values.append(_compiled("assign").match(own).group(2) if kind == 0 else own)
                    at = max(at, end)
                rest.append(text[at:])
                ordinary = _compiled("ordinary").findall("\n".join(rest))
                values = [t for v in values for t in _compiled("ordinary").findall(v)]
                for label, tokens in ((0, ordinary), (1, values)):
                    seen[label] += np.bincount(_pairs(tokens), minlength=_N * _N)
        label, pair = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(seen[label, pair])],
            names=["label", "pair", "n"],
        )

    rows = sample.select("text").mapInArrow(count, "label int, pair int, n bigint").groupBy("label", "pair")
    counts = np.zeros((2, _N, _N))
    for row in rows.agg(F.sum("n").alias("n")).collect():
        counts[row.label, row.pair // _N, row.pair % _N] = row.n
    smooth = counts + 1.0
    # Few secrets are seen, so their pairs lean on single characters, and those on a uniform draw.
    single = counts[1].sum(0) + 1.0
    smooth[1] = counts[1] + 50.0 * single / single.sum()
    chance = smooth / smooth.sum(2, keepdims=True)
    return np.log2(chance[1] / chance[0])


def spans_of(text: str, ratio: list[list[float]]) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind: the fixed ones, and random tokens that overlap none of them."""
    base = base_spans(text)
    found = list(base)
    for m in _compiled("token").finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, _, e in base):
            continue
        token = m.group()
        if not any(c.isdigit() for c in token):
            continue
        if score(token, ratio) >= LEAST_BITS * len(token):
            found.append((start, 3, end))
    return sorted(found)


def score(token: str, ratio: list[list[float]]) -> float:
    """Log-likelihood ratio of a token in bits."""
    states, before, bits = _index(), _N - 1, 0.0
    for c in token:
        now = states[c]
        bits += ratio[before][now]
        before = now
    return bits


def _index() -> dict[str, int]:
    return T.worker_store().setdefault("secret states", {c: i for i, c in enumerate(ALPHABET)})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    table = ratio.tolist()

    def run(batch: pa.RecordBatch):
        rows = []
        for text in batch.column(1).to_pylist():
            spans = spans_of(text or "", table)
            kinds = [kind for _, kind, _ in spans]
            base = _joined([s for s in spans if s[1] < 3]).encode()
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(base).hexdigest(), _joined(spans)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
        )

    return T.map_batches(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string",
        run,
    )


def redact(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, every span replaced by ``mark`` (overlapping spans by one) and the length renewed."""
    table, names = ratio.tolist(), docs.columns
    at = names.index(text_col)
    n_at = names.index(chars_col) if chars_col in names else None

    def run(batch: pa.RecordBatch):
        texts = batch.column(at).to_pylist()
        changed = {}
        for i, text in enumerate(texts):
            spans = spans_of(text, table) if text else []
            if spans:
                parts, done = [], 0
                for start, _, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                changed[i] = "".join(parts) + text[done:]
        columns = batch.columns
        if changed:
            columns[at] = pa.array([changed.get(i, text) for i, text in enumerate(texts)], pa.string())
            if n_at is not None:
                own = columns[n_at].to_pylist()
                columns[n_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(own)], columns[n_at].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return T.map_batches(docs, docs.schema, run)


T.ship_by_value(__name__)
