"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are joined at stable boundaries.

A chunk's tokens near its edges may differ from those of the whole text.  Two neighbouring chunks are joined at a
position of their overlap where both have a token boundary next to white space and the same ``GUARD`` tokens (ids and
offsets) on either side: the tokenizer's pieces end at white space, so what stands on one side has no say in the other.
Where no such position exists (no white space, say) the overlap is widened; in the end the whole text is one chunk.
Tokenizers whose pieces may run on behind white space, and those of ``.model`` files, get whole texts.
"""

from __future__ import annotations

import os
import re
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

CHUNK = 65_536
OVERLAP = 2_048
GUARD = 4
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer in a file, once a process, without truncation and padding."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = t
    return _loaded[path]


def ends_at_blanks(tok) -> bool:
    """Whether the tokenizer's pieces never run on from other characters into white space and behind it."""
    pre = getattr(tok, "pre_tokenizer", None)
    if pre is None:
        return False
    signs = [*string.ascii_letters, *string.digits, *string.punctuation, *"éßñЖя漢あ€—’…", "ab", "12", "don't", "..", "--"]
    probes = [blank.join(signs) + blank for blank in (" ", "\t", "\n", "  ", "\r\n", "\u3000", "\u00a0")]
    pieces = [probe[a:b] for probe in probes for _, (a, b) in pre.pre_tokenize_str(probe)]
    return not any(re.search(r"\S\s", p) for p in pieces)


def _tokens(tok, text: str, base: int) -> list[tuple[int, int, int]]:
    e = tok.encode(text, add_special_tokens=False)
    return [(base + a, base + b, i) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def boundary(left: list, right: list, text: str, low: int, high: int, guard: int = GUARD) -> int | None:
    """A position in (low, high) at which token lists of two chunks may be joined, or None."""
    same: list[tuple] = []
    there = {t for t in right if low <= t[0] and t[1] <= high}
    runs: list[list[tuple]] = [same]
    for t in left:
        if t[0] < low or t[1] > high:
            continue
        if t in there:
            runs[-1].append(t)
        elif runs[-1]:
            runs.append([])
    best = max(runs, key=len)
    middle = len(best) // 2
    for i in sorted(range(guard, len(best) - guard + 1), key=lambda i: abs(i - middle)):
        if best[i - 1][1] <= best[i][0] and (text[best[i - 1][1]].isspace() or text[best[i][0]].isspace()):
            return best[i][0]
    return None


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> int:
    """Tokens of the text, encoded in overlapping chunks; equal to encoding it whole."""
    total, start, begin = 0, 0, 0  # begin: the splice; tokens before it are counted
    end = min(len(text), chunk)
    left = _tokens(tok, text[start:end], start)
    while end < len(text):
        wide = overlap
        while True:
            low = max(end - wide, begin)
            if low <= begin:  # the overlap would swallow the chunk: make the chunk longer instead
                end = min(len(text), end + max(chunk, end - start))
                left = _tokens(tok, text[start:end], start)
                if end == len(text):
                    return total + sum(t[0] >= begin for t in left)
                wide = overlap
                continue
            far = min(len(text), low + chunk + wide)
            right = _tokens(tok, text[low:far], low)
            cut = boundary(left, right, text, low, end, guard)
            if cut is not None:
                break
            wide *= 2
        total += sum(begin <= t[0] < cut for t in left)
        start, begin, end, left = low, cut, far, right
    return total + sum(t[0] >= begin for t in left)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs(doc_id, text)``; other columns are not read.

    No begin, end or other special tokens are added; special strings inside texts count as the library's default has
    them.  A null text counts as empty (0 bytes, 0 tokens).  Null and repeated doc_ids keep all their rows.  An empty
    table gives an empty table.  ``.json`` files go to tokenizers, ``.model`` files to sentencepiece.
    """

    def count():
        tok = tokenizer(path)
        piece = path.endswith(".model")
        chunks = not piece and ends_at_blanks(tok)

        def whole(texts):
            if piece:
                return map(len, tok.encode(texts, num_threads=1))
            return map(len, tok.encode_batch_fast(texts, add_special_tokens=False))

        def run(texts):
            texts = [t or "" for t in texts]
            out = [count_spliced(tok, t, chunk) if len(t) > chunk and chunks else -1 for t in texts]
            small = [i for i, n in enumerate(out) if n < 0]
            for i, n in zip(small, whole([texts[i] for i in small]), strict=True):
                out[i] = n
            return [out]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return map_text(rows, count, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
