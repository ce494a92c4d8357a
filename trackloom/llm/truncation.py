"""Texts that stop before their end, and how often each source cuts.

Per source, the lengths of all texts, in characters and in bytes, are counted; a length that is far
more frequent than those beside it is a field limit. A text of such a length without terminal
punctuation is doubted; so is, at any length, a text that ends without it, as transfers break off
anywhere. What doubt remains is settled by how the corpus itself ends: the last words of a doubted
text are looked up among all runs of one to three words, counted over all documents by whether a
line, sentence or item ends after them or goes on. Words after which nothing ever ends, or that occur
nowhere else, are a cut. At a field limit the ends must be common, elsewhere merely possible.
Closing lines are those that end many texts; brackets, quotes, fences, tables and rows that are left
open are a cut by themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, sized

#: Words, with digits or with apostrophes; times; numbers; single marks.
WORD, REST = r"[^\W\d_]+(?:\d+|(?:['’][^\W\d_]+)*)", r"\d{1,2}:\d{2}(?::\d{2})?(?!\d)|\d+(?:[.,]\d+)*|\S"
TOKEN = re.compile(f"{WORD}|{REST}")
#: The same and what is blank between them: every character of a text is in one match.
PIECE = re.compile(rf"{WORD}|\s+|{REST}")
LINE = re.compile("[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
#: Kinds of tokens, as bits.
NAMELIKE, ENDS, ENDS_ALONE, BETWEEN, CLOSES, BLANK, BREAKS, STOP = 1, 2, 4, 8, 16, 32, 64, 128
TERMINAL = ".!?;。！？；"
CLOSERS = "\"'”’»)]}*_`~"
#: Marks that show where something was cut or trails off; what precedes them decides.
TRAILING = re.compile(r"(?:\s*(?:\.{2,}|…+|\[(?:…|\.\.\.|truncated|more|cut)\]|\((?:…|\.\.\.|truncated|more|cut)\)|-{2,}>|>>+|→))+\s*$", re.IGNORECASE)
#: What such marks end in.
MARK_ENDS = tuple(".…])>→")
#: Where data in braces begins.
OBJECT = re.compile(r"(?:\[\s*)?\{\s*\"[^\"\n]{1,60}\"\s*:")
#: What opens, closes and quotes in such data; a backslash takes the next character with it.
STRUCTURAL = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
#: Texts of at most so many characters without a mark, away from a field limit, are whole.
SHORT = 24
#: Least number of texts with unlike contents, not at a sharp limit, that end in a line for it to be a closing one, and
#: the least share of all texts that do so, by the lower end of a one-sigma interval: the same at any size of the corpus.
CLOSING_TEXTS, CLOSING_RATE = 4, 1.6e-4
#: What opens, closes and quotes in such data; a backslash takes the next character with it.
STRUCTURAL = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
#: Texts of at most so many characters without a mark, away from a field limit, are whole.
SHORT = 24
#: A line closes texts if in some source at least so many, with unlike contents and not at a sharp limit, end in it, and
#: if the share of the source's texts that do so is at least CLOSING_RATE, by the lower end of a two-sigma interval.
CLOSING_TEXTS, CLOSING_RATE = 4, 4e-4
#: A length is a field limit if it has at least so many texts, and so many times the mean of the lengths within NEAR of it.
SPIKE_TEXTS, SPIKE_RATIO, NEAR = 6, 5.0, 12
#: Observations from which a run of words decides.
ENOUGH = 4
#: A field limit is a sharp one from this ratio.
SHARP_RATIO = 20.0
#: Least share of ends after a run of two or three words: elsewhere, at a field limit or before a mark, at a sharp limit.
END_SHARE, END_SHARE_AT_LIMIT, END_SHARE_AT_SHARP = 0.04, 0.15, 0.5
#: The same where only the last word by itself is known.
LONE_SHARE, LONE_SHARE_AT_LIMIT = 0.12, 0.5
#: A last line belongs to the line before it, as a name does to a greeting, if that has at most so many characters.
SIGNED = 24
#: Observations of a run of two or three words that never ends anything from which even a closing line is none.
CONTRARY = 20

P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Bits of the filter of asked keys for each of them, at most so many in all (32 MB), bits set per key.
FILTER_BITS, FILTER_MOST, PROBES = 12, 1 << 28, 4
#: Bits of a segment of the filter, which is what tasks send.
SEGMENT = 1 << 20
#: Tokens whose runs are counted at once.
AT_ONCE = 400_000


def without_mark(text: str) -> str:
    """text without the marks at its end."""
    if not text.rstrip().endswith(MARK_ENDS):
        return text
    size = 80
    while True:
        found = TRAILING.search(text, max(0, len(text) - size))
        # a mark that reaches the beginning of what was searched may go on before it
        if found is None or found.start() > len(text) - size + 12 or size >= len(text):
            return text if found is None else text[: found.start()]
        size *= 4


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s)


class _Words(dict):
    """Code of every token and blank, with hash and kind by code; numbers and, in context within a sentence, names lose
    their identity. Code 0 is the border between two texts."""

    NAME, BREAK = np.uint64(_hash("<name>")), np.uint64(_hash("\n"))

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds = [0], [STOP]

    def __missing__(self, token: str) -> int:
        kind = 0
        if token.isspace():
            h, kind = 0, BLANK | (BREAKS if LINE.search(token) else 0)
        elif token[0].isdigit():
            h = _hash("#:##" if ":" in token else "#")
        elif token[-1].isdigit():
            # a code: letters and as many digits
            h = _hash(re.sub(r"\d", "0", token))
        else:
            h = _hash(token.lower())
            kind = NAMELIKE * (token[:1].isupper() and token[1:2].islower()) + ENDS * (token in TERMINAL) + ENDS_ALONE * (token in "。！？") + BETWEEN * (token in "/|") + CLOSES * (token in CLOSERS)
        code = len(self.hashes)
        self.hashes.append(h)
        self.kinds.append(kind)
        self[token] = code
        return code

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and kinds by code."""
        return np.array(self.hashes, np.uint64), np.array(self.kinds, np.int16)

    def tidied(self) -> _Words:
        """Itself, or a new one where it has grown large."""
        return self if len(self) < 500_000 else _Words()


def _joined(last: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the runs of one, two and three tokens with these last tokens and contexts."""
    with np.errstate(over="ignore"):
        two = last * P2 + c1 + np.uint64(1)
        return last, two, two * P3 + c2 + np.uint64(2)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint64).view(np.int64)


def last_runs(tails: list[list[str]], words: _Words) -> np.ndarray:
    """Keys of the runs of one, two and three tokens at the end of each list of one to four last tokens, one row each.

    A list of fewer than four tokens begins a line.
    """
    n = len(tails)
    size = np.fromiter(map(len, tails), np.int64, n)
    codes = np.zeros((n, 4), np.int64)
    for k, t in enumerate(tails):
        codes[k, 4 - len(t) :] = [words[x] for x in t]
    hashes, kinds = words.known()
    last, kind = hashes[codes], kinds[codes]
    name = kind & NAMELIKE > 0
    name[:, 1:] &= kind[:, :-1] & ENDS == 0
    name[np.arange(4) <= 4 - size[:, None]] = False
    context = np.where(name, _Words.NAME, last)
    zero = np.uint64(0)
    c1 = np.where(size == 1, _Words.BREAK, context[:, 2])
    c2 = np.where(size == 1, zero, np.where(size == 2, _Words.BREAK, context[:, 1]))
    return np.stack([_signed(r) for r in _joined(last[:, 3], c1, c2)], 1)


def might_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys (uint64) that may be in the filter; none of those that are is missing."""
    at = np.arange(len(keys))
    size = np.uint64(8 * len(bits))
    for place in _probes(keys, size):
        where = place[at]
        at = at[bits[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return at


def _probes(keys: np.ndarray, size: np.uint64) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        h = (keys ^ (keys >> np.uint64(31))) * P2
        step = (keys * P3) | np.uint64(1)
        for k in range(PROBES):
            yield ((h + np.uint64(k) * step) >> np.uint64(8)) % size


def word_runs(texts: list[str | None], words: _Words, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, ends, goes on: all runs of words in the texts, except those at the very end of a text; of a filter's keys alone if it is given."""
    found: list[str] = []
    codes: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        if codes:
            parts.append(_counted(np.concatenate(codes), words, asked))
            codes.clear()

    held = 0
    for text in texts:
        if not text:
            continue
        # a trailing mark belongs to the text's own end
        found = PIECE.findall(without_mark(text.strip()))
        codes.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
        codes.append(np.zeros(1, np.int64))
        held += len(found)
        if held >= AT_ONCE:
            add()
            held = 0
    add()
    if not parts:
        z = np.array([], np.int64)
        return z, z, z
    key, end = (np.concatenate(v) for v in zip(*parts))
    unique, code = np.unique(key, return_inverse=True)
    total = np.bincount(code, minlength=len(unique))
    ended = np.bincount(code, weights=end, minlength=len(unique)).astype(np.int64)
    return _signed(unique), ended, total - ended


def _counted(codes: np.ndarray, words: _Words, asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of whole texts, each with whether something ends there. Texts are divided by code 0."""
    hashes, kinds = words.known()
    all_kinds = kinds[codes]
    token = np.flatnonzero(all_kinds & (BLANK | STOP) == 0)
    if not len(token):
        return np.array([], np.uint64), np.array([], bool)
    after = all_kinds[token + 1]
    last, kind = hashes[codes[token]], all_kinds[token]
    final = np.append(np.cumsum(all_kinds & STOP > 0)[token], -1)
    final = final[1:] != final[:-1]
    begin = np.append(True, final[:-1])
    ahead = final | (after & BREAKS > 0)
    spaced = final | (after & BLANK > 0)
    broken = np.append(False, ahead[:-1]) & ~begin
    # names in context
    name = (kind & NAMELIKE > 0) & ~broken & ~begin
    name[1:] &= kind[:-1] & ENDS == 0
    context = np.where(name, _Words.NAME, last)
    # a sentence ends where terminal punctuation is followed by blank or the line's end
    terminal = (kind & ENDS > 0) & (spaced | (kind & ENDS_ALONE > 0))
    end = ahead.copy()
    end[:-1] |= (terminal[1:] | ((kind[1:] & BETWEEN > 0) & spaced[:-1])) & ~ahead[:-1]
    # the text's own end, with what closes it, is no evidence
    first = np.flatnonzero(begin)
    at = np.arange(len(token))
    body = np.maximum.reduceat(np.where(kind & (ENDS | CLOSES) == 0, at, -1), first)
    keep = (kind & ENDS == 0) & (at < np.repeat(np.maximum(body, first), np.diff(np.append(first, len(token)))))
    # contexts; a line break counts as a token, missing context is 0
    zero = np.uint64(0)
    b1 = np.where(begin, zero, np.append(zero, context[:-1]))
    second = np.append(False, begin[:-1])
    b2 = np.where(begin | second, zero, np.concatenate((np.zeros(2, np.uint64), context[:-2]))[: len(token)])
    before = np.append(False, broken[:-1]) & ~begin
    c1 = np.where(broken, _Words.BREAK, b1)
    c2 = np.where(broken, b1, np.where(before, _Words.BREAK, b2))
    runs = _joined(last[keep], c1[keep], c2[keep])
    ends = end[keep]
    if asked is None:
        return np.concatenate(runs), np.tile(ends, 3)
    held = [might_hold(asked, r) for r in runs]
    return np.concatenate([r[h] for r, h in zip(runs, held)]), np.concatenate([ends[h] for h in held])


def asked_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column key, n rows, as bytes: bits of tasks combined by segment, at most FILTER_MOST in all."""
    segments = int(min(max(1, -(-n * FILTER_BITS // SEGMENT)), FILTER_MOST // SEGMENT))
    size = np.uint64(segments * SEGMENT)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for place in _probes(b.column("key").to_numpy().view(np.uint64), size):
                part = (place // np.uint64(SEGMENT)).astype(np.int64)
                for k in np.unique(part):
                    here = np.zeros(SEGMENT, bool)
                    here[(place[part == k] % np.uint64(SEGMENT)).astype(np.int64)] = True
                    packed = np.packbits(here, bitorder="little")
                    held[k] = held[k] | packed if k in held else packed
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("segment").to_pylist(), b.column("bits").to_pylist()):
                v = np.frombuffer(v, np.uint8)
                held[k] = held[k] | v if k in held else v
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["segment", "bits"])

    schema = "segment int, bits binary"
    out = np.zeros(segments * SEGMENT // 8, np.uint8)
    for r in keys.select("key").mapInArrow(bits, schema).repartition("segment").mapInArrow(merge, schema).collect():
        out[r["segment"] * SEGMENT // 8 :][: SEGMENT // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _structure(text: str) -> str:
    """'open' if the text is data or code that isn't closed, 'closed' if it is, else ''."""
    body = text.strip(" \t\r\n\ufeff\u200b")
    start = OBJECT.search(body) if "{" in body else None
    if start:
        depth, quoted, end, at = 0, False, len(body), start.start()
        for found in STRUCTURAL.finditer(body, at):
            c = found[0]
            if len(c) > 1:
                continue
            if c == '"':
                quoted = not quoted
            elif not quoted:
                depth += 1 if c in "{[" else -1
                if depth <= 0:
                    end = found.end()
                    break
        if depth or quoted:
            return "open"
        if not body[end:].strip(" \t\r\n;,]"):
            return "closed"
    if body.count("```") % 2:
        return "open"
    if body.endswith("```"):
        return "closed"
    lines = [x for x in body.splitlines() if x.strip()]
    if len(lines) >= 2:
        for mark in (",", "\t", "|"):
            counts = [x.count(mark) for x in lines]
            if counts[0] >= 2 and ", " not in lines[0] and (counts[-2] == counts[0] if len(lines) > 2 else mark != "\t") and counts[-1] < counts[0] and all(c == counts[0] for c in counts[:-1]):
                return "open"
    return ""


def last_tokens(plain: str) -> list[str]:
    """The last tokens of the last line, four or more if it has them, without the punctuation that ends it."""
    size = 160
    while True:
        tail = plain[-size:]
        whole = size >= len(plain)
        lines = tail.splitlines()
        line = lines[-1] if lines else ""
        if len(lines) < 2 and not whole:
            # tokens never reach across blanks, so from the first one on they are those of the line
            blank = re.search(r"\s", line)
            line = line[blank.end() :] if blank else ""
        tokens = TOKEN.findall(line)
        while tokens and (tokens[-1] in TERMINAL or tokens[-1] in CLOSERS):
            tokens.pop()
        if whole or len(lines) > 1 or len(tokens) >= 5:
            return tokens
        size *= 4


def ending(text: str | None) -> tuple[str, list[str], str, str]:
    """What the end of a text says: (verdict, last tokens, closing phrase, what is before that phrase).

    The verdict is whole, cut, or ask where the corpus must tell; marked- stands before ask where a
    trailing mark was taken off, dotted- where the text ends in a number and a full stop. A phrase
    that is a line of its own begins with a line break, with two if it takes in a short line before it.
    """
    if text is None or not text.strip():
        return "whole", [], "", ""
    body = text.rstrip()
    structure = _structure(body)
    if structure:
        return ("cut" if structure == "open" else "whole"), [], "", ""
    while body and (0x2600 <= ord(body[-1]) <= 0x27BF or ord(body[-1]) >= 0x1F000 or ord(body[-1]) in (0xFE0F, 0x200D)):
        body = body[:-1].rstrip()
    bare = without_mark(body)
    marked = bare != body
    plain = bare.rstrip(CLOSERS + " ") if not marked else bare
    ended = bool(plain) and plain[-1] in TERMINAL
    lines = bare.splitlines() or [""]
    # the last phrase: the last line, or what follows the last sentence in it
    parts = re.split(r"(?<=[.!?。！？])\s+", lines[-1].strip().rstrip("."))
    alone = len(parts) == 1 and len(lines) > 1
    signed = alone and 0 < len(lines[-2].strip()) <= SIGNED and lines[-2].strip()[-1] not in TERMINAL + CLOSERS
    phrase = "\n" * alone + (f"\n{lines[-2].strip()}\n" if signed else "") + parts[-1]
    phrase = re.sub(r"\d+", "0", phrase.lower())
    # what stands before it: the rest of its line and the two lines before that hold anything
    above = [x for x in lines[-6:-1] if x.strip()] if sum(map(bool, map(str.strip, lines[-6:-1]))) >= 2 else [x for x in lines[:-1] if x.strip()]
    before = "\n".join([*above[-2:], *parts[:-1]])
    tokens = last_tokens(plain)
    if ended and not marked and not (tokens and tokens[-1][0].isdigit() and plain[-1] == "."):
        return "whole", tokens[-4:], phrase, before
    if not tokens:
        return "whole", [], phrase, before
    return ("marked-ask" if marked else "dotted-ask" if ended else "ask"), tokens[-4:], phrase, before


def _endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes, verdict, keys (one to three), phrase, before, and whether the last token is a number or has one or two letters and the phrase is alone in its line, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            words = words.tidied()
            texts = b.column("text").to_pylist()
            n = len(texts)
            got = list(map(ending, texts))
            asked = [k for k, (verdict, tokens, _, _) in enumerate(got) if tokens and verdict.endswith("ask")]
            keys: list[list[int]] = [[]] * n
            if asked:
                for k, row in zip(asked, last_runs([got[k][1] for k in asked], words).tolist()):
                    keys[k] = row
            signed = lambda values: pa.array(_signed(np.fromiter(map(_hash, values), np.uint64, n)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("source"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([g[0] for g in got], pa.string()), pa.array(keys, pa.list_(pa.int64())), signed([g[2] for g in got]), signed([g[3] for g in got]),
                    pa.array([bool(g[1]) and g[1][-1][0].isdigit() for g in got], pa.bool_()), pa.array([bool(g[1]) and len(g[1][-1]) < 3 and g[1][-1].isalpha() for g in got], pa.bool_()),
                    pa.array([len(g[2]) - len(g[2].lstrip("\n")) for g in got], pa.int32()),
                ],
                names=["doc_id", "source", "chars", "bytes", "verdict", "keys", "phrase", "before", "number", "tiny", "alone"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, chars long, bytes long, verdict string, keys array<long>, phrase long, before long, number boolean, tiny boolean, alone int")


def _corpus_runs(documents: DataFrame, asked: Broadcast) -> DataFrame:
    """key, ends, goes_on of the runs of words of all documents that may be asked for, combined by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            words = words.tidied()
            key, ends, on = word_runs(b.column("text").to_pylist(), words, asked.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ends), pa.array(on)], names=["key", "ends", "goes_on"])

    return documents.where(F.col("text").isNotNull()).select(F.col("text").cast("string")).mapInArrow(run, "key long, ends long, goes_on long")


def field_limits(endings: DataFrame) -> DataFrame:
    """source, unit, length, n, ratio: lengths far more frequent than those beside them."""
    lengths = endings.where("chars > 0").select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "length"))
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    near = F.sum("n").over(Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR))
    spikes = counts.withColumn("ratio", F.col("n") * 2 * NEAR / F.greatest(near - F.col("n"), F.lit(1)))
    return spikes.where((F.col("n") >= SPIKE_TEXTS) & (F.col("ratio") >= SPIKE_RATIO) & (F.col("length") >= 64))


def _left_open(text: str = "text") -> Column:
    """Whether the text ends without terminal punctuation, closing marks and blanks after it left aside."""
    return ~F.regexp_replace(F.col(text), r"[ \t\n\r\f\x0B]+$", "").rlike(r"[.!?;。！？；][\"'”’»)\]}*_`~ ]*$")


def documents_at_limit(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes of the texts whose length, in characters or bytes, is a field limit of their source and that end without terminal punctuation.

    This is the rule of lengths by itself. Null, empty and blank texts have no length.
    """
    d = documents.select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), _left_open().alias("open")).where(F.regexp_replace("text", r"[ \t\n\r\f\x0B]", "") != "")
    limits = cut_lineage(field_limits(d).select(F.col("source").alias("_s"), "unit", "length"))
    chars, size = (limits.where(F.col("unit") == u).select("_s", F.col("length").alias(n)) for u, n in (("chars", "chars"), ("bytes", "bytes")))
    here = d.where("open").drop("open")
    by_chars = here.join(sized(chars), F.col("source").eqNullSafe(F.col("_s")) & (here["chars"] == chars["chars"]), "left_semi")
    by_bytes = here.join(sized(size), F.col("source").eqNullSafe(F.col("_s")) & (here["bytes"] == size["bytes"]), "left_semi")
    return by_chars.unionByName(by_bytes).distinct()


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, source, at_limit, truncated, by of every document.

    by is the rule that found a truncated text: limit (its length is a field limit of its source),
    structure (something is left open), mark (a mark at its end), ending (the corpus goes on after
    such an end); null for whole texts. Null, empty and blank texts are not truncated. A null source is
    a source of its own. Rows with the same doc_id are judged one by one. An empty table gives no rows.
    """
    ends = cut_lineage(_endings(documents).withColumn("row", F.monotonically_increasing_id()))
    # the histogram's spikes are few: a source and length with at least SPIKE_TEXTS texts each
    limits = cut_lineage(field_limits(ends).select("source", "unit", "length", F.when(F.col("ratio") >= SHARP_RATIO, 2).otherwise(1).alias("hit")))
    by_chars = limits.where("unit = 'chars'").select(F.col("source").alias("_s"), F.col("length").alias("_l"), F.col("hit").alias("_c"))
    by_bytes = limits.where("unit = 'bytes'").select(F.col("source").alias("_t"), F.col("length").alias("_m"), F.col("hit").alias("_b"))
    docs = ends.join(sized(by_chars), F.col("source").eqNullSafe(F.col("_s")) & (F.col("chars") == F.col("_l")), "left")
    docs = docs.join(sized(by_bytes), F.col("source").eqNullSafe(F.col("_t")) & (F.col("bytes") == F.col("_m")), "left")
    docs = docs.withColumn("limit", F.greatest(F.coalesce("_c", F.lit(0)), F.coalesce("_b", F.lit(0)))).withColumn("at_limit", F.col("limit") > 0).select("row", "doc_id", "source", "chars", "verdict", "keys", "phrase", "before", "limit", "at_limit", "number", "tiny", "alone")
    asked = docs.where("verdict like '%ask'")
    # closing phrases: many texts, unlike before them, end so
    total = ends.count()
    unlike = F.approx_count_distinct("before", 0.05)
    outside = F.approx_count_distinct(F.when(F.col("limit") < 2, F.col("before")), 0.05)
    phrases = asked.groupBy("phrase", "alone").agg(unlike.alias("all"), outside.alias("outside")).withColumn("n", F.when(F.col("alone") > 0, F.col("all")).otherwise(F.col("outside")))
    often = (F.col("n") >= CLOSING_TEXTS) & (F.col("n") - F.sqrt("n") >= CLOSING_RATE * total) & (F.col("outside") >= 1)
    closing = cut_lineage(phrases.where(often).groupBy("phrase").agg(F.max(F.col("alone") == 2).alias("signed"), F.lit(True).alias("closing")))
    wanted = cut_lineage(asked.select(F.explode("keys").alias("key")).distinct())
    bits = documents.sparkSession.sparkContext.broadcast(asked_filter(wanted, wanted.count()))
    runs = _corpus_runs(documents, bits).join(sized(wanted), "key", "left_semi").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    each = asked.select("row", F.posexplode("keys").alias("n", "key")).join(runs, "key", "left")
    per = each.groupBy("row").agg(*[F.max(F.when(F.col("n") == k, F.coalesce(c, F.lit(0)))).alias(f"{c}{k}") for k in range(3) for c in ("ends", "goes_on")])
    judged = asked.join(sized(closing), "phrase", "left").join(per, "row", "left")
    marked = F.col("verdict") == "marked-ask"
    doubt = F.col("at_limit") | marked
    least = F.when(F.col("limit") == 2, END_SHARE_AT_SHARP).when(doubt, END_SHARE_AT_LIMIT).otherwise(END_SHARE)
    lone = F.when(doubt, LONE_SHARE_AT_LIMIT).otherwise(LONE_SHARE)
    share, least_here = F.lit(None).cast("double"), lone
    for k in range(3):
        e, g = F.coalesce(f"ends{k}", F.lit(0)), F.coalesce(f"goes_on{k}", F.lit(0))
        enough = (e + g >= (ENOUGH if k else 2)) & (F.lit(k > 0) | ~F.col("tiny"))
        share = F.when(enough, e / (e + g)).otherwise(share)
        least_here = F.when(enough & F.lit(k > 0), least).otherwise(least_here)
    contrary = F.lit(False)
    for k in (1, 2):
        e, g = F.coalesce(f"ends{k}", F.lit(0)), F.coalesce(f"goes_on{k}", F.lit(0))
        contrary = contrary | ((e + g >= CONTRARY) & (e / (e + g) < END_SHARE))
    long = (F.col("chars") > SHORT) | doubt
    doubted = F.when(share.isNull(), True).otherwise((share < least_here) | (F.col("number") & (F.col("limit") == 2)))
    # a full stop after a number is one, unless such numbers go on with a unit
    cut = ~(F.coalesce("closing", F.lit(False)) & (F.col("signed") | ~contrary)) & F.when(F.col("verdict") == "dotted-ask", contrary).otherwise(doubted & long)
    rule = F.when(F.col("at_limit"), "limit").when(marked, "mark").otherwise("ending")
    settled = docs.where("verdict in ('whole', 'cut')").select("doc_id", "source", "at_limit", (F.col("verdict") == "cut").alias("truncated"), F.when(F.col("verdict") == "cut", "structure").alias("by"))
    return settled.unionByName(judged.select("doc_id", "source", "at_limit", cut.alias("truncated"), F.when(cut, rule).alias("by")))


def truncated_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents whose text stops before its end, each once."""
    return classified(documents).where("truncated").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, n, n_truncated, rate, n_at_limit, and how many truncated texts each rule found: by_limit, by_structure, by_mark, by_ending."""
    rules = [F.sum(F.when(F.col("by") == r, 1).otherwise(0)).alias(f"by_{r}") for r in ("limit", "structure", "mark", "ending")]
    return classified(documents).groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("rate"), F.sum((F.col("truncated") & F.col("at_limit")).cast("long")).alias("n_at_limit"), *rules
    )
