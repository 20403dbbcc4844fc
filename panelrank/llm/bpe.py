"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark partitions.

A text is cut into words by the tokenizer's pattern. Words that are tokens themselves are looked
up; all others of a chunk become rows (word, position, token) of their bytes. One recursive query
joins every adjacent pair with the merge table, picks each word's leftmost pair of smallest rank,
contracts it, and repeats until no word has a pair left. Decoding joins token rows with the
vocabulary and aggregates their bytes in order of position.

Texts: missing counts as empty (no tokens, no bytes). Every row is coded on its own, so repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelrank.llm.common import map_texts, releasing, sha256

# Words beyond this many bytes are merged with a queue: the recursive query keeps a row per
# token and step, which for one word grows with the square of its length.
LONGEST_ROWS = 256
# Words per recursive query, and words a task remembers between batches.
WORDS_PER_QUERY = 25_000
REMEMBERED = 600_000

_CONTRACT = """
WITH RECURSIVE step AS (
  SELECT 0 AS n, word, pos, tok, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos
  FROM pieces WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT n + 1, word, pos,
         CASE WHEN pos = spot THEN merged ELSE tok END,
         CASE WHEN next_pos = spot THEN merged WHEN pos = spot THEN gone_tok ELSE next_tok END,
         CASE WHEN pos = spot THEN gone_pos ELSE next_pos END
  FROM (
    SELECT s.*, spot, merged, gone, g.next_tok AS gone_tok, g.next_pos AS gone_pos
    FROM step AS s
    JOIN (
      SELECT word,
             min((id::BIGINT << 32) | (pos::BIGINT << 16) | next_pos) AS best,
             (best >> 32)::INT AS merged, (best >> 16) & 65535 AS spot, best & 65535 AS gone
      FROM step JOIN merges ON l = tok AND r = next_tok
      GROUP BY word
    ) USING (word)
    JOIN step AS g ON g.word = s.word AND g.pos = gone
  )
  WHERE pos <> gone
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step SEMI JOIN (SELECT word, max(n) AS n FROM step GROUP BY word) USING (word, n)
GROUP BY word
"""

_JOIN_BYTES = """
SELECT item, string_agg(hex, '' ORDER BY pos) AS hex
FROM tokens LEFT JOIN vocab USING (id) GROUP BY item
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """The merge table, the vocabulary and the words seen so far, one per task."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.words_of = regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(max(self.ranks.values()) + 1)]
        self.byte_ids = np.array(
            [self.ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32
        )
        left, right, merged = [], [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table(
            {n: pa.array(v, pa.int32()) for n, v in zip(("l", "r", "id"), (left, right, merged))}
        )
        vocab = pa.table(
            {
                "id": pa.array(list(self.ranks.values()), pa.int32()),
                "hex": pa.array([token.hex() for token in self.ranks], pa.string()),
            }
        )
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.seen: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [self.words_of(text) if text else [] for text in texts]
        here = set().union(*words)
        if len(self.seen) > REMEMBERED:
            # The rare words go; those that are used again just now are mostly frequent ones.
            self.seen = {word: self.seen[word] for word in here & self.seen.keys()}
        seen = self.seen
        new = [word for word in here if word not in seen]
        rows = []
        for word in new:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                seen[word] = np.int32(whole).tobytes()
            elif len(raw) > LONGEST_ROWS:
                seen[word] = np.array(self._queue(raw), dtype=np.int32).tobytes()
            else:
                rows.append(word)
        for start in range(0, len(rows), WORDS_PER_QUERY):
            self._contract(rows[start : start + WORDS_PER_QUERY])
        look = seen.__getitem__
        return [np.frombuffer(b"".join(map(look, w)), dtype=np.int32) for w in words]

    def _contract(self, words: list[str]) -> None:
        raw = [word.encode() for word in words]
        sizes = np.array([len(b) for b in raw])
        starts = np.cumsum(sizes) - sizes
        pieces = pa.table(
            {
                "word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
                "pos": (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32),
                "tok": self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)],
            }
        )
        self.db.register("pieces", pieces)
        out = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("pieces")
        lists = out.column("ids").combine_chunks()
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        for word, start, end in zip(out.column("word").to_pylist(), [0, *ends[:-1]], ends):
            self.seen[words[word]] = ids[start:end].tobytes()

    def _queue(self, raw: bytes) -> list[int]:
        """The same contraction of one long word, with a heap of (rank, position)."""
        ids = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        parts = [raw[i : i + 1] for i in range(len(raw))]
        after = [*range(1, len(raw)), -1]
        before = [-1, *range(len(raw) - 1)]
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                rank = self.ranks.get(parts[i] + parts[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))

        for i in range(len(raw)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], ids[i], parts[j] = a + b, rank, b""
            after[i] = after[j]
            after[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x, part in zip(ids, parts) if part]

    def decode(self, ids: Iterable[np.ndarray | list[int] | None]) -> list[bytes]:
        """Ids outside the vocabulary stand for no bytes."""
        arrays = [np.asarray([] if x is None else x, dtype=np.int32) for x in ids]
        sizes = np.array([len(x) for x in arrays], dtype=np.int64)
        flat = np.concatenate([*arrays, np.empty(0, dtype=np.int32)])
        tokens = pa.table(
            {
                "item": np.repeat(np.arange(len(arrays)), sizes),
                "pos": np.arange(len(flat)),
                "id": flat,
            }
        )
        self.db.register("tokens", tokens)
        found = dict(self.db.execute(_JOIN_BYTES).fetchall())
        self.db.unregister("tokens")
        return [bytes.fromhex(found.get(i) or "") for i in range(len(arrays))]


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The running task's coder."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def forget() -> None:
    """Drop a task's coders: Spark keeps Python workers for the stages that follow."""
    while _CODERS:
        _CODERS.popitem()[1].db.close()


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every text: (id, ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        return {id_col: kept[id_col], "ids": coder(path, pattern).encode(texts)}

    return map_texts(docs, [id_col], text_col, f"`{id_col}` {id_type}, ids array<int>", work, forget)


def decode(
    coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Bytes of every id list: (id, data). A missing list gives no bytes."""
    id_type = coded.schema[id_col].dataType.simpleString()
    names = [id_col, "data"]

    def run(batches):
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    data = coder(path, pattern).decode(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(data, pa.binary())], names=names
                    )
        finally:
            forget()

    return coded.select(id_col, ids_col).mapInArrow(
        releasing(run), f"`{id_col}` {id_type}, data binary"
    )


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, decode its ids again, and keep counts and digests of both.

    Columns: id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space),
    ``decoded_sha256`` (decoded bytes), ``lossless`` (they equal the text's). Doing both in one
    pass keeps the ids, several times the table's size, inside the worker that made them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        here = coder(path, pattern)
        ids = here.encode(texts)
        data = here.decode(ids)
        return {
            id_col: kept[id_col],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [
                sha256(" ".join(map(here.decimal.__getitem__, x.tolist())).encode()) for x in ids
            ],
            "decoded_sha256": [sha256(x) for x in data],
            "lossless": [x == (text or "").encode() for x, text in zip(data, texts)],
        }

    return map_texts(
        docs,
        [id_col],
        text_col,
        f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string,"
        " lossless boolean",
        work,
        forget,
    )
