"""Live credentials over a whole corpus: index, suppress, confirm, search again, mask.

1. Every text is read once. All its literals (quoted texts and runs without blanks, quotes and brackets, of `MIN_LENGTH`
   characters and more) go into an index of hashes with owner and line; what stands in a credential place goes in as it is, too.
2. Suppress: a value that more than `MAX_OWNERS` owners show anywhere, as a literal of more than `MAX_CONTEXTS` different lines, is
   a placeholder, whatever it looks like. Copies of one text do not make a placeholder: they share the line. Values whose
   own shape proves them (keys of known issuers, key blocks) are exempt.
3. Confirm: of the others, those that stand in a credential place, or in a scanner's excerpt, and are built like a credential.
4. Search again: every text is read for the confirmed values in any context. A Bloom filter of the values' first words,
   opening stretches and whole stretches marks texts, which are joined by whole stretches with the values they hold, so that
   values with one opening (key blocks) do not multiply; an automaton over the values of each batch of texts then finds the
   places. One pass, whatever the number of values; a task holds the values of its own texts only.
5. These places, and no others, are put out, or the texts with them masked and all other characters kept.

The working tables hold the values found; they are removed before the result is handed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritmill.llm import bloom
from gritmill.llm.credentials import _MASK, MIN_LENGTH, structured, values
from gritmill.operators.nested import nodes
from gritmill.session import discard, materialise_at

#: A value is a placeholder if more than so many owners show it in more than so many different lines.
MAX_OWNERS, MAX_CONTEXTS = 20, 12
#: A value is looked up by its first word, by its opening stretches of so many words, twice as many and so on, and by all its words.
STRETCH = 3

_INDEX = "h bigint, owner bigint, context bigint, word string, first bigint, issued boolean, built boolean, src string, rec_id bigint, pos string"
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _INDEX.split(", ")]
_ASSIGNED = re.compile(r"^\s*(?:<|[\"'`]?[A-Za-z_][\w.\-:]*[\"'`]?\s*[:=](?!//))")
_LITERAL = re.compile(rf"[\"'`]([^\"'`\n]{{{MIN_LENGTH},}})(?=[\"'`])|([^\s\"'`“”‘’<>=;,(){{}}\[\]|&]{{{MIN_LENGTH},}})")
_RUN = re.compile(r"[^\W_]+")
#: An option of one letter with its value behind it.
_GLUED = re.compile(r"(?<![\w\-])-[A-Za-z](?=[^\W_])")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def anchors(word: str) -> tuple[int, int] | None:
    """Hashes of the first run of letters and digits, and of the stretch up to the end of the run STRETCH - 1 behind it."""
    runs = list(_RUN.finditer(word))
    if not runs:
        return None
    return _hash(runs[0][0]), _hash(word[runs[0].start() : runs[min(STRETCH, len(runs)) - 1].end()], 1)


def stretches(word: str) -> list[int]:
    """Hashes of the opening stretches of STRETCH, 2 * STRETCH, ... runs, and at the end of the stretch of all runs."""
    runs = list(_RUN.finditer(word))
    sizes, n = [], STRETCH
    while n < len(runs):
        sizes.append(n)
        n *= 2
    return [_hash(word[runs[0].start() : runs[n - 1].end()], 1) for n in [*sizes, len(runs)]] if runs else []


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values with the hash of all their runs and all keys of the filter."""
    for b in batches:
        words, firsts = (c.to_pylist() for c in b.columns)
        keys = [stretches(w) for w in words]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[-1] for k in keys], pa.int64()), pa.array([[f, *k] for f, k in zip(firsts, keys)], pa.list_(pa.int64()))], names=["word", "whole", "keys"])


def shown_value(match: str | None) -> str | None:
    """The value that a scanner's excerpt shows: of an assignment what stands in the credential place, else the excerpt itself."""
    if not match:
        return None
    found = values(match)
    built = [f for f in found if _built(f.value, f.issued)]
    if found:
        return (built or found)[0].value
    return match.strip() if not _ASSIGNED.match(match) and structured(match) else None


def _built(value: str, issued: bool, named: bool = True) -> bool:
    return (issued and not _MASK.search(value)) or structured(value, named)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shown: dict[tuple[int, int], int] = {}
        words: dict[str, tuple] = {}
        for owner, text in zip(*(c.to_pylist() for c in b.columns)):
            if not text:
                continue
            who = _hash(owner) if owner is not None else 0
            for line in text.split("\n"):
                literals = _LITERAL.findall(line)
                if literals:
                    context = _hash(line.strip())
                    for quoted, bare in literals:
                        shown.setdefault((_hash((quoted or bare).strip()), who), context)
            for f in values(text):
                h = _hash(f.value)
                a = text.rfind("\n", 0, f.start) + 1
                shown.setdefault((h, who), _hash(text[a : max(f.end, a + 200)].split("\n")[0].strip()))
                for w in {f.value, text[f.start : f.end].strip()}:
                    if w not in words and (at := anchors(w)):
                        words[w] = (h, None, None, w, at[0], f.issued, _built(f.value, f.issued), None, None, None)
        yield _batch([(h, who, c, *[None] * 7) for (h, who), c in shown.items()] + list(words.values()))


def _read_shown(src: str, extract):
    """What a scanner shows: its value as one of a credential place, with the place of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rec_id, owner, pos, shown in zip(*(c.to_pylist() for c in b.columns)):
                v = extract(shown)
                if v is None or not (at := anchors(v)):
                    continue
                h, named = _hash(v), src == "trivy"
                rows.append((h, _hash(owner) if owner is not None else 0, _hash(shown.strip()), v, at[0], False, _built(v, False, named), src, rec_id, pos))
            yield _batch(rows)

    return run


def literal_index(report: DataFrame, gitleaks: DataFrame, trivy: DataFrame) -> DataFrame:
    """Step 1: every literal of every text as (h, owner, context), and what stands in credential places with its value. Rows without an id are left out."""
    texts = report.where("row_id IS NOT NULL").select("repo", F.col("evidence.snippet")).mapInArrow(_read_texts, _INDEX)
    g = nodes(gitleaks, ["delivery_id", "repo"], ["runs", "results"], {"shown": F.col("__el.partialFingerprints")["secret"]})
    g = g.where("delivery_id IS NOT NULL").select("delivery_id", "repo", "node", "shown").mapInArrow(_read_shown("gitleaks", lambda v: v.strip() if v else None), _INDEX)
    t = nodes(trivy, ["delivery_id", "repo"], ["Results", "Secrets"], {"shown": "Match"})
    t = t.where("delivery_id IS NOT NULL").select("delivery_id", "repo", "node", "shown").mapInArrow(_read_shown("trivy", shown_value), _INDEX)
    return texts.unionByName(g).unionByName(t)


def judged(index: DataFrame) -> DataFrame:
    """Steps 2 and 3: ``(h, word, first, owners, contexts, issued, placeholder, confirmed)`` of everything in a credential place."""
    words = index.where("word IS NOT NULL").groupBy("h", "word").agg(F.first("first").alias("first"), F.bool_or("issued").alias("issued"), F.bool_or("built").alias("built"))
    of_owner = index.where("owner IS NOT NULL").join(words.select("h").distinct(), "h", "left_semi").groupBy("h", "owner").agg(F.min("context").alias("context"))
    counts = of_owner.groupBy("h").agg(F.count("*").alias("owners"), F.count_distinct("context").alias("contexts"))
    out = words.join(counts, "h", "left").withColumn("placeholder", F.expr(f"NOT issued AND owners > {MAX_OWNERS} AND contexts > {MAX_CONTEXTS}"))
    return out.withColumn("confirmed", F.expr("built AND NOT placeholder"))


def _marked(f: bloom.Filter):
    """Texts that may hold a confirmed value, with the hashes of the stretches that the filter lets through: longer ones only behind their openings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = f.load()
        known: dict[str, int] = {}

        def of(runs: list[str]) -> list[int]:
            if len(known) > 300_000:  # bounds the worker's memory
                known.clear()
            out = []
            for r in runs:
                h = known.get(r)
                if h is None:
                    h = known[r] = _hash(r)
                out.append(h)
            return out

        def inside(hashes: list[int]) -> np.ndarray:
            return bloom.contains(bitmap, bloom.mixed(np.array(hashes, np.int64)), f.bits)

        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            firsts, owner = [], []
            for i, text in enumerate(texts):
                if text:
                    hs = of(_RUN.findall(text))
                    if "-" in text:
                        hs += [_hash(_RUN.match(text, m.end())[0]) for m in _GLUED.finditer(text)]
                    firsts += hs
                    owner += [i] * len(hs)
            if not firsts:
                continue
            rows = []
            for i in np.unique(np.array(owner)[inside(firsts)]):
                text = texts[i]
                runs = list(_RUN.finditer(text))
                ends = [m.end() for m in runs]
                starts = [(m.start(), k) for k, m in enumerate(runs)]
                starts += [(m.end(), k) for m in _GLUED.finditer(text) for k in [int(np.searchsorted(ends, m.end(), side="right"))]]
                ok = inside([_hash(text[s : ends[k]]) for s, k in starts])
                alive = [x for x, o in zip(starts, ok) if o]
                kept: set[int] = set()
                low, high = 1, STRETCH
                while alive:
                    tried = [(s, k, n, _hash(text[s : ends[k + n - 1]], 1)) for s, k in alive for n in range(low, min(high, len(ends) - k) + 1)]
                    passed = [x for x, o in zip(tried, inside([x[3] for x in tried])) if o] if tried else []
                    kept.update(x[3] for x in passed)
                    alive = [(s, k) for s, k, n, _ in passed if n == high]
                    low, high = high + 1, 2 * high
                if kept:
                    rows.append((ids[i], text, sorted(kept)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["row_id", "text", "stretches"])

    return run


def hits(text: str, automaton) -> list[tuple[int, int]]:
    """Places of the automaton's values as whole tokens, none that starts inside another."""
    spans = []
    for last, n in automaton.iter(text):
        start, stop = last - n + 1, last + 1
        left = start == 0 or not text[start - 1].isalnum() or bool(start > 1 and _GLUED.match(text, start - 2))
        if left and (stop == len(text) or not text[stop].isalnum()):
            spans.append((start, stop))
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, z))
    return out


def _searched(emit, names: list[str], types: list[pa.DataType]):
    """`emit(row_id, text, spans)` over texts given with the values they may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, words = (c.to_pylist() for c in b.columns)
            automaton = ahocorasick.Automaton()
            for w in {w for ws in words for w in ws}:
                automaton.add_word(w, len(w))
            automaton.make_automaton()
            rows = [r for i, t in zip(ids, texts) if (spans := hits(t, automaton)) for r in emit(i, t, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


class Search:
    """Steps 1 to 4. `result` writes what is asked for; `close` removes all tables that hold values."""

    def __init__(self, report: DataFrame, gitleaks: DataFrame, trivy: DataFrame) -> None:
        self.spark, self.report, self.at = report.sparkSession, report, []
        self.index = self._keep(literal_index(report, gitleaks, trivy), "secrets-index")
        self.judged = self._keep(judged(self.index), "secrets-values")
        self.confirmed = self.judged.where("confirmed")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df, at = materialise_at(df, name)
        self.at.append(at)
        return df

    def shown_places(self) -> DataFrame:
        """``(src, rec_id, pos)`` of what scanners show, if the value is confirmed and built like one there."""
        own = self.index.where("src IS NOT NULL AND built")
        return own.join(self.confirmed.select("h").distinct(), "h", "left_semi").select("src", "rec_id", "pos")

    def texts(self) -> DataFrame:
        """``(row_id, text, words)`` of every text that may hold confirmed values, with these values. Rows that repeat an id stay apart."""
        keyed = self._keep(self.confirmed.select("word", "first").mapInArrow(_keyed, "word string, whole bigint, keys array<bigint>"), "secrets-keys")
        n = keyed.select(F.sum(F.size("keys"))).first()[0] or 0
        f = bloom.merged(keyed.select(F.explode("keys").alias("k")), ["k"], n, repeated=False)
        rows = self.report.where("row_id IS NOT NULL").select("row_id", F.col("evidence.snippet"))
        marked = rows.mapInArrow(_marked(f), "row_id bigint, text string, stretches array<bigint>")
        marked = self._keep(marked.withColumn("uid", F.monotonically_increasing_id()), "secrets-marked")
        own = marked.select("uid", F.explode("stretches").alias("whole")).join(keyed.select("whole", "word"), "whole")
        own = own.groupBy("uid").agg(F.collect_set("word").alias("words"))  # values of one text
        return marked.join(own, "uid").select("row_id", "text", "words")

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialise_at(df, name)[0]

    def close(self) -> None:
        discard(self.spark, *self.at)


def found_places(report: DataFrame, gitleaks: DataFrame, trivy: DataFrame) -> DataFrame:
    """``(src, rec_id, pos)`` of every live credential, each place once. Empty tables give no rows."""

    def emit(i: int, text: str, spans: list[tuple[int, int]]) -> list[tuple]:
        return [("report", i, p) for p in {str(_line(text, a)) for a, _ in spans}]

    search = Search(report, gitleaks, trivy)
    try:
        schema = ["src", "rec_id", "pos"], [pa.string(), pa.int64(), pa.string()]
        places = search.texts().mapInArrow(_searched(emit, *schema), "src string, rec_id bigint, pos string")
        return search.result(places.unionByName(search.shown_places()).distinct(), "secrets-places")
    finally:
        search.close()


_HEX_PAIR = re.compile(r"0x[0-9A-Fa-f]{1,2}")
_PEM_LINE = re.compile(r"-----(?:BEGIN|END)[^\n-]*-----")
_SECRET_CHARS = re.compile(r"[^\s\"'`“”‘’]")
_JOIN = re.compile(r"[\"'`“”‘’]\s*(?:\+|&|\.)\s*[@$]{0,2}[\"'`“”‘’]")


def mask_value(value: str) -> str:
    """A value masked in its place: as long as before, quotes, joins, line ends and block marks kept."""
    if _HEX_PAIR.match(value):
        return _HEX_PAIR.sub(lambda m: "0x" + "0" * (len(m[0]) - 2), value)
    keep = [m.span() for rule in (_PEM_LINE, _JOIN) for m in rule.finditer(value)]
    keep += [m.span() for m in re.finditer(r"\\[nrt]", value)] if keep else []
    return "".join(c if any(a <= i < b for a, b in keep) else _SECRET_CHARS.sub("*", c) for i, c in enumerate(value))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with `spans` masked; overlapping spans count as one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask_value(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def masked_snippets(report: DataFrame, gitleaks: DataFrame, trivy: DataFrame) -> DataFrame:
    """``(row_id, n_places, masked)`` of every snippet with a live credential; all other text is as it was.

    Rows that repeat an id are masked each in its own text.
    """

    def emit(i: int, text: str, spans: list[tuple[int, int]]) -> list[tuple]:
        return [(i, len(spans), mask(text, spans))]

    search = Search(report, gitleaks, trivy)
    try:
        schema = ["row_id", "n_places", "masked"], [pa.int64(), pa.int32(), pa.string()]
        return search.result(search.texts().mapInArrow(_searched(emit, *schema), "row_id bigint, n_places int, masked string"), "secrets-masked")
    finally:
        search.close()
