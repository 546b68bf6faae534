"""Operator 5: token counts by byte-pair merging with a heap and a linked list."""
from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches

SPACE = "▁"
CACHED_WORDS = 400_000
#: A word with the spaces before it, spaces alone, or a line break.
WORDS = re.compile(r" *[^ \n]+| +|\n")


class Merges:
    """The ranks of a vocabulary's pieces, and the number of tokens of a text.

    Merging stays inside stretches between characters that stand side by side in no piece.
    Equal stretches have equal counts, which are kept for the words met most recently.
    """

    def __init__(self, pieces: dict[str, float]):
        self.ranks = {p: rank for p, rank in pieces.items() if len(p) > 1}
        self.chars = {p for p in pieces if len(p) == 1}
        self.pairs = {p[i:i + 2] for p in self.ranks for i in range(len(p) - 1)}
        # a line break parts words, so no piece may cross one; nor may a piece cross from a word into spaces
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces of this vocabulary cross words")
        self.words: dict[str, int] = {}

    def stretch(self, s: str) -> int:
        """Tokens of a stretch: symbols at first, less one for each merge."""
        n, ranks = len(s), self.ranks
        if n == 1:
            return 1 if s in self.chars else len(s.encode("utf-8", "surrogatepass"))
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(s[i:i + 2])) is not None]
        heapify(heap)
        count = n
        while heap:
            _, i, span = heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != span:
                continue                                     # one of the two was merged meanwhile
            count -= 1
            size[i], size[j] = span, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(s[i:k + size[k]])) is not None:
                    heappush(heap, (r, i, span + size[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(s[h:i + span])) is not None:
                heappush(heap, (r, h, size[h] + span))
        if any(c not in self.chars for c in s):              # such symbols never merge and become bytes
            count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in s if c not in self.chars)
        return count

    def word(self, w: str) -> int:
        s = w.replace(" ", SPACE)
        total, at, known = 0, 0, self.words
        for k in range(1, len(s) + 1):
            if k == len(s) or s[k - 1:k + 1] not in self.pairs:
                part = s[at:k]
                n = known.get(part)
                if n is None:
                    n = known[part] = self.stretch(part)
                total, at = total + n, k
        known[w] = total
        return total

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        words = WORDS.findall(" " + text.replace(SPACE, " "))   # the vocabulary takes both for a space
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            return sum([known[w] if w in known else self.word(w) for w in words])


@lru_cache(maxsize=2)
def merges(vocabulary: str) -> Merges:
    """Pieces and scores from a sentencepiece model: a higher score merges first."""
    import public_tokenizers as files
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=files.path(vocabulary))
    plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    if m.normalize(" ½ a  b ") != SPACE * 2 + "½" + SPACE + "a" + SPACE * 2 + "b" + SPACE:
        raise ValueError("the vocabulary changes texts before it merges")
    return Merges({m.id_to_piece(i): -m.get_score(i) for i in plain})


def count_tokens(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model",
                 limit: int = 4096) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row's whole text.

    General: the project's records are numbers and short codes, so any table with an id and a
    text will do. The lowest-ranked adjacent pair is popped from a heap and merged in a linked
    list until no pair is a piece; the count is the number of symbols less the merges. No ids
    are made. Characters without a piece count as their UTF-8 bytes, as the library splits them.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids come out each.
    Other columns are not read. The cache of a task is bounded.
    """
    sql, arrow = id_type(rows, id_col)
    types = pa.schema([("i", arrow), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(i, t):
        m = merges(vocabulary)
        n = [m.tokens(x or "") for x in t]
        return {"i": i, "n_bytes": [len((x or "").encode("utf-8", "surrogatepass")) for x in t], "n_tokens": n, "over_limit": [k > limit for k in n]}

    d = rows.select(F.col(id_col).cast(sql).alias("i"), F.col(text_col).cast("string").alias("t"))
    return map_batches(d, count, f"i {sql}, n_bytes bigint, n_tokens bigint, over_limit boolean", types).withColumnRenamed("i", id_col)
