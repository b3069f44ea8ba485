"""Cutting texts that are too long at natural boundaries, by merging from the smallest segments up."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.llm.bpe import Encoder, encoder, read_vocabulary, text_of

#: Strength of a boundary: none, word, sentence, paragraph.
NONE, WORD, SENTENCE, PARAGRAPH = range(4)

#: Characters that end a sentence, those that may follow them, and those that end one without a blank.
_ENDS, _CLOSERS, _WIDE = frozenset(".!?…。！？"), frozenset("\"'»“”’)]"), frozenset("。！？")
#: A character has at most so many tokens, one a byte.
MOST_A_CHARACTER = 4


def _cut_word(word: str, enc: Encoder, longest: int) -> Iterator[tuple[int, int]]:
    """(length, tokens) of parts of a word, in order: each of at most ``longest`` tokens, or a single character."""
    waiting = [word]
    while waiting:
        part = waiting.pop()
        n = len(enc.word(part))
        if n <= longest or len(part) == 1:
            yield len(part), n
            continue
        step = min(len(part) // 2, max(1, len(part) * longest // (2 * n)))
        waiting += [part[k : k + step] for k in range(0, len(part), step)][::-1]


def _atoms(words: list[str], sizes: list[int], enc: Encoder, longest: int) -> tuple[list[int], list[int], bool]:
    """Ends and token counts of the smallest segments, and whether a word of more than ``longest`` tokens was cut."""
    if max(sizes) <= longest:
        return list(accumulate(map(len, words))), sizes, False
    lengths, counts = [], []
    for word, size in zip(words, sizes):
        for length, n in ((len(word), size),) if size <= longest else _cut_word(word, enc, longest):
            lengths.append(length)
            counts.append(n)
    return list(accumulate(lengths)), counts, True


def _ends_paragraph(text: str, cut: int) -> bool:
    """Whether the white space around the cut, however long, has two line ends and the cut is behind it or before its last character, an indent's."""
    if text[cut].isspace():
        if text[cut] == "\n" or not text[cut - 1].isspace() or cut + 1 == len(text) or text[cut + 1].isspace():
            return False
    elif text[cut - 1] != "\n":
        return False
    begin = cut
    while begin and text[begin - 1].isspace():
        begin -= 1
    return text.count("\n", begin, cut) > 1


def _strength(text: str, cut: int) -> int:
    """Of the boundary before ``text[cut]``; white space belongs to what follows, a line end to what precedes."""
    before, after = text[cut - 1], text[cut]
    if before.isspace():
        if _ends_paragraph(text, cut):
            return PARAGRAPH
        if after.isspace():
            return NONE
        return SENTENCE if before == "\n" else WORD
    if not after.isspace():
        return SENTENCE if before in _WIDE else NONE
    k = cut - 1
    while k and text[k] in _CLOSERS:
        k -= 1
    return SENTENCE if text[k] in _ENDS else WORD


def split_text(text: str, enc: Encoder, limit: int = 800, overlap: int = 64) -> list[tuple[int, int, int, int]]:
    """(begin, core, end, tokens) of each piece; text[begin:core] repeats the end of the piece before.

    Neighbouring segments wait in a heap by the strength of the boundary between them, then by joint size; the weakest is
    merged as long as the joint size, with the overlap still to come, is within the limit. A text within the limit is one
    piece. A piece never has more than ``limit`` tokens. Its overlap has at most ``overlap``, each word of it counted as in
    the text (a word of more than half the overlap is cut between characters, whose parts are counted one by one).
    ``limit`` must hold any single character, and the overlap be less than half of it.
    """
    return _split(text, *_measure(text, enc), enc, limit, overlap) if text else [(0, 0, 0, 0)]


def _measure(text: str, enc: Encoder) -> tuple[list[str], list[int]]:
    """The words of a text, which put together give it, and the tokens of each."""
    words, known = enc.find(text), enc.words.get
    return words, [len(known(w) or enc.word(w)) for w in words]


def _split(text: str, words: list[str], sizes: list[int], enc: Encoder, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    if limit < MOST_A_CHARACTER:
        raise ValueError(f"a character may have {MOST_A_CHARACTER} tokens, more than the limit")
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    if sum(sizes) <= limit:
        return [(0, 0, len(text), sum(sizes))]
    budget, repeat, longest = limit, overlap, max(1, min(overlap, limit - overlap) // 2)
    # Every round that fails leaves a smaller budget. Below twice the overlap the overlap is halved, and the atoms with it; in
    # the end there is no overlap, nothing is merged and an atom is a character, which is within the limit.
    while True:
        ends, counts, torn = _atoms(words, sizes, enc, longest)
        total = list(accumulate(counts, initial=0))
        pieces = [(b, c, e, enc.count(text[b:e]) if torn else n - _joined(text, b, e, total, ends, enc)) for b, c, e, n in _merge(text, ends, total, budget, repeat)]
        over = max(n for *_, n in pieces) - limit
        if over <= 0:
            return pieces
        budget -= over
        while repeat and budget < 2 * repeat:
            repeat, longest = repeat // 2, max(1, longest // 2)
        if budget <= 0:
            longest = 1


def _joined(text: str, begin: int, end: int, total: list[int], ends: list[int], enc: Encoder) -> int:
    """By how many tokens the white space at the end of a piece counts less there than in the text.

    Words are found from left to right, and only white space looks at what follows it. So a piece that begins and ends with
    words of the text has the same words, but for white space at its end, which is one word there and may be two in the text.
    """
    start = end
    while start > begin and text[start - 1].isspace():
        start -= 1
    if start == end or end == len(text):
        return 0
    first = bisect_right(ends, start)  # the atom that begins at ``start``
    return total[bisect_left(ends, end) + 1] - total[first] - len(enc.word(text[start:end]))


def _merge(text: str, ends: list[int], total: list[int], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(begin, core, end, tokens) of each piece, the tokens being those of its atoms."""
    n = len(ends)
    strength = [PARAGRAPH] + [_strength(text, k) for k in ends[:-1]]  # of the boundary before atom i
    after = list(range(1, n + 1))  # first atom behind the segment that starts here
    before = list(range(-1, n - 1))  # start of the segment before
    alive = bytearray([1]) * n

    # segments only grow: a pair that does not fit never will, and is not kept. A pair's key is its strength, size and place as
    # the digits of one number, which sorts as they would
    wide = (limit + 1) * n
    base = [s * wide for s in strength]
    heap = [base[i] + (total[i + 1] - total[i - 1]) * n + i for i in range(1, n) if total[i + 1] - total[i - 1] + (overlap if i > 1 else 0) <= limit]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        key = pop(heap)
        i = key % n
        if not alive[i]:
            continue
        left, end = before[i], after[i]
        if key - base[i] != (total[end] - total[left]) * n + i:
            continue  # it has grown since, and is in the heap with its new size if that fits
        alive[i] = 0
        after[left] = end
        if end < n:
            before[end] = left
            grown = total[after[end]] - total[left]
            if grown + (overlap if left else 0) <= limit:
                push(heap, base[end] + grown * n + end)
        if left:
            first = before[left]
            grown = total[end] - total[first]
            if grown + (overlap if first else 0) <= limit:
                push(heap, base[left] + grown * n + left)
    pieces, i, since = [], 0, 0
    while i < n:
        end = after[i]
        begin = _overlap_start(i, since, strength, total, overlap) if i else 0
        pieces.append((ends[begin - 1] if begin else 0, ends[i - 1] if i else 0, ends[end - 1], total[end] - total[begin]))
        i, since = end, begin
    return pieces


def _overlap_start(i: int, since: int, strength: list[int], total: list[int], overlap: int) -> int:
    """The atom from which the piece before is repeated: at most ``overlap`` tokens, at the best boundary in the first half.

    Within the piece before, which starts at ``since``. Paragraph before sentence before word ends; of equal ones the first.
    Without any, as many whole atoms as fit.
    """
    first = max(since, bisect_left(total, total[i] - overlap, 0, i))
    half = [k for k in range(first, i) if total[i] - total[k] >= overlap // 2] or list(range(first, i))
    if not half:
        return i
    best = max(half, key=lambda k: (strength[k], -k))
    return best if strength[best] > NONE else first


def split_corpus(df: DataFrame, id_column: str, text_column: str, limit: int = 800, overlap: int = 64, path: str | None = None) -> DataFrame:
    """(id, piece_no, begin, core, end, n_tokens, piece) of every text of more than ``limit`` tokens; see split_text.

    Offsets are in code points; ``piece`` is the text from begin to end, and text from core on is what the piece before does
    not hold, so the cores put together give the text. Texts within the limit, null and empty ones give no row. Bytes that
    are no UTF-8 count as U+FFFD. One narrow pass, texts whole.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "begin", "core", "end", "n_tokens")), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for batch in batches:
            keys, rows = batch.column(0), []
            for k, raw in enumerate(batch.column(1)):
                value = raw.as_py()
                if value is None or len(value) <= limit:
                    continue  # a token has a byte at least
                text = text_of(value)
                words, sizes = _measure(text, enc)
                if sum(sizes) > limit:
                    rows += ((k, no, b, c, e, n, text[b:e]) for no, (b, c, e, n) in enumerate(_split(text, words, sizes, enc, limit, overlap)))
            if rows:
                k, *rest = zip(*rows)
                columns = [keys.take(pa.array(k, pa.int32())), *(pa.array(c, pa.int32()) for c in rest[:-1]), pa.array(rest[-1], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "piece_no", "begin", "core", "end", "n_tokens", "piece"])

    return df.select(id_column, F.col(text_column).cast("binary").alias("_text")).mapInArrow(run, schema)
