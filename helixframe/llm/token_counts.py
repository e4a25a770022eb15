"""Token counts: batches of about equal bytes go to the tokenizer inside Arrow functions; only lengths come back.

Texts over ``segment`` characters are cut where no token can cross: at a single space between two ASCII
letters. Every supported vocabulary starts a new piece there (checked when a sentencepiece model is loaded:
no piece holds a word mark after another character), so the parts' counts add up to the count of the whole.

Null and empty texts have no bytes and no tokens. Rows repeat as given; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None):
    """(lengths of a list of texts, characters dropped at a cut, whether texts may be cut) of a tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        cuts = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), 1, cuts
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [len(model.encode_ordinary(x)) for x in texts]), 0, True
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]), 0, True


def segments(text: str, size: int, drop: int) -> Iterator[str]:
    """Parts of a text whose token counts add up to the text's."""
    at, look = 0, size
    while len(text) - at > 2 * size:
        cut = text.find(" ", look)
        if cut < 0 or cut + 1 >= len(text):
            break
        a, b = text[cut - 1], text[cut + 1]
        if a.isascii() and a.isalpha() and b.isascii() and b.isalpha():
            yield text[at:cut]
            at = cut + drop
            look = at + size
        else:
            look = cut + 1
    yield text[at:]


def _counter(path: str, pattern: str | None, batch_bytes: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, drop, cuts = encoder(path, pattern)
        for batch in batches:
            ids, column = batch.column(0), pc.fill_null(batch.column(1), "")
            size = pc.cast(pc.binary_length(column), pa.int64())
            total = np.zeros(len(column), np.int64)
            parts: list[str] = []
            owners: list[int] = []
            held = 0
            for i in range(len(column) + 1):
                if parts and (i == len(column) or held >= batch_bytes):
                    np.add.at(total, owners, lengths(parts))
                    parts, owners, held = [], [], 0
                if i == len(column):
                    break
                text = column[i].as_py()
                if not text:
                    continue
                for part in segments(text, segment, drop) if cuts else (text,):
                    parts.append(part)
                    owners.append(i)
                    held += len(part)
                    if held >= batch_bytes:
                        np.add.at(total, owners, lengths(parts))
                        parts, owners, held = [], [], 0
            yield pa.RecordBatch.from_arrays([ids, size, pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None,
                 batch_bytes: int = 1 << 18, segment: int = 1000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text under the tokenizer file ``path``, which all nodes can open.

    ``pattern`` is the split pattern of a .tiktoken file. ``batch_bytes`` bounds a call of the tokenizer,
    ``segment`` the length from which a text is cut.
    """
    return rows_of(docs, id_col, text_col).mapInArrow(_counter(path, pattern, batch_bytes, segment), SCHEMA)


def over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Mark the texts longer than a context of ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
