"""How an index's postings are made: packed by the tasks that read the rows, sent to their slice as few large values, unpacked in order there.

A pack holds what a (bucket, slice) gets of up to PACK_TOKENS tokens: its rows' keys and lengths once, its terms in order, and, compressed, the
postings of each term with the number of their row among the pack's, their count and positions. Exploded tokens would travel at several times the size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that a task holds before it sends packs; postings of an Arrow batch that leaves a task.
PACK_TOKENS, OUT_ROWS = 1_000_000, 50_000
_KINDS = (np.uint8, np.uint16, np.uint32)


def write_order(docs: DataFrame, key: str, tokens: Column, buckets: int, slices: int) -> DataFrame:
    """(term, key, tf, _dl, pos, bucket) in a task for each (bucket, slice of the key), in order of bucket, term and key."""
    kind = docs.schema[key].dataType
    packed = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("lengths", T.ArrayType(T.DoubleType())),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("body", T.BinaryType()),
        ]
    )
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField(key, kind), T.StructField("tf", T.IntegerType()), T.StructField("_dl", T.DoubleType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("bucket", T.IntegerType())])
    # by _dl, not by the tokens, which a filter would make once more
    rows = docs.filter("_dl > 0").select(F.col(key).alias("key"), F.col("_dl").alias("length"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), tokens.alias("tokens"))
    packs = rows.mapInArrow(_packer(buckets, slices, _arrow(packed)), packed)
    return packs.repartitionById(buckets * slices, F.col("part")).drop("part").mapInArrow(_unpacker(_arrow(out)), out)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The same rows in tables of about `most` tokens, or of one row with more."""
    wait, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + (not wait), int(np.searchsorted(ends, before + most - n, "right")))
            if to > at:
                wait.append(batch.slice(at, to - at))
                n += int(ends[to - 1]) - before
                at, before = to, int(ends[to - 1])
            if at < batch.num_rows or n >= most:
                yield pa.Table.from_batches(wait)
                wait, n = [], 0
    if wait:
        yield pa.Table.from_batches(wait)


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    top = int(x.max(initial=0))
    i = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return i, x.astype(_KINDS[i])


def _seal(*parts: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in its narrowest kind."""
    small = [_narrow(x) for x in parts]
    head = np.array([y for (i, x) in small for y in (i, len(x))], np.int64).tobytes()
    body = b"".join([head, *(x.tobytes() for _, x in small)])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unseal(body: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    head, at, out = np.frombuffer(raw, np.int64, 2 * n), 16 * n, []
    for i, size in head.reshape(n, 2).tolist():
        out.append(np.frombuffer(raw, _KINDS[i], size, at))
        at += size * _KINDS[i]().itemsize
    return out


def _starts(*same: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(same[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in same])
    return np.flatnonzero(new)


def _packer(buckets: int, slices: int, schema: pa.Schema):
    def packs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("tokens").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        # words in order of bucket and word, the one that is null first; it is in no bucket and travels with the first
        bucket = np.array([-1 if w is None else zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words.to_pylist()], np.int64)
        by_word = np.empty(len(words), np.int64)
        by_word[pc.sort_indices(words, null_placement="at_start").to_numpy()] = np.arange(len(words))
        order = np.lexsort((by_word, bucket))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        words, bucket = words.take(pa.array(order)), bucket[order]
        word = rank[code]
        doc = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        part = np.maximum(bucket, 0)[word] * slices + rows.column("slice").to_numpy()[doc]
        by = np.argsort(part * len(words) + word, kind="stable")  # rows and positions are in order already
        part, word, doc, pos = part[by], word[by], doc[by], pos[by]
        first = _starts(part, word, doc)
        tf = np.diff(np.append(first, len(doc)))
        ppart, pword, pdoc = part[first], word[first], doc[first]
        own = bucket[pword]
        edges = np.append(_starts(ppart, own), len(ppart))
        at_token = np.append(first, len(doc))
        keys, lengths = rows.column("key").combine_chunks(), rows.column("length").to_numpy()
        got = {name: [] for name in schema.names}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            docs, at = np.unique(pdoc[a:b], return_inverse=True)
            heads = _starts(pword[a:b])
            got["part"].append(int(ppart[a]))
            got["bucket"].append(None if own[a] < 0 else int(own[a]))
            got["keys"].append(docs)
            got["terms"].append(pword[a:b][heads])
            got["body"].append(_seal(np.diff(np.append(heads, b - a)), at, tf[a:b], pos[at_token[a] : at_token[b]]))
        of_docs, of_terms = [np.concatenate(got[x]) for x in ("keys", "terms")]
        ends = lambda xs: pa.array(np.cumsum([0, *map(len, xs)]), pa.int32())
        lists = {"keys": (got["keys"], keys.take(pa.array(of_docs))), "lengths": (got["keys"], pa.array(lengths[of_docs])), "terms": (got["terms"], words.take(pa.array(of_terms)))}
        made = {x: pa.ListArray.from_arrays(ends(cut), values) for x, (cut, values) in lists.items()}
        yield pa.RecordBatch.from_arrays([(made[x.name] if x.name in made else pa.array(got[x.name], x.type)).cast(x.type) for x in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches, PACK_TOKENS):
            yield from packs(rows)

    return run


def _merged(word: np.ndarray, doc: np.ndarray, tf: np.ndarray, begin: np.ndarray, pos: np.ndarray, by_key: np.ndarray, lengths: np.ndarray):
    """Postings with those of one word, key and length joined, their positions in order."""
    by = np.lexsort((lengths[doc], by_key[doc], word))
    word, doc, tf, begin = word[by], doc[by], tf[by], begin[by]
    first = _starts(word, by_key[doc], lengths[doc])
    total = np.add.reduceat(tf, first)
    token = np.arange(tf.sum()) + np.repeat(begin - (np.cumsum(tf) - tf), tf)
    pos = pos[token]
    pos = pos[np.lexsort((pos, np.repeat(np.arange(len(first)), total)))]
    return word[first], doc[first], total, np.cumsum(total) - total, pos


def _unpacker(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        packs = pa.Table.from_batches(full)
        opened = [_unseal(b, 4) for b in packs.column("body").to_pylist()]
        flat = lambda name: pa.chunked_array([c.flatten() for c in packs.column(name).chunks]).combine_chunks()
        keys, lengths = flat("keys"), flat("lengths").to_numpy()
        n_terms = pc.list_value_length(packs.column("terms")).to_numpy()
        coded = pc.dictionary_encode(flat("terms"), null_encoding="encode")
        words = coded.dictionary
        bucket_of = np.empty(len(words), np.int64)
        bucket_of[coded.indices.to_numpy()] = np.repeat(pc.fill_null(packs.column("bucket"), -1).to_numpy(), n_terms)
        by_word = np.empty(len(words), np.int64)
        by_word[pc.sort_indices(words, null_placement="at_start").to_numpy()] = np.arange(len(words))
        order = np.lexsort((by_word, bucket_of))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        words, bucket_of = words.take(pa.array(order)), bucket_of[order]
        n_docs = pc.list_value_length(packs.column("keys")).to_numpy().astype(np.int64)
        offset = np.cumsum(n_docs) - n_docs
        word = np.repeat(rank[coded.indices.to_numpy()], np.concatenate([x[0] for x in opened]))
        doc = np.concatenate([x[1].astype(np.int64) + o for x, o in zip(opened, offset.tolist(), strict=True)])
        tf = np.concatenate([x[2].astype(np.int64) for x in opened])
        pos = np.concatenate([x[3].astype(np.int32) for x in opened])
        del opened, packs, full
        sorted_keys = pc.sort_indices(keys, null_placement="at_start").to_numpy()
        by_key = np.empty(len(keys), np.int64)
        by_key[sorted_keys] = np.arange(len(keys))
        begin = np.cumsum(tf) - tf
        same = keys.take(pa.array(sorted_keys))
        if len(pc.unique(keys)) < len(keys):  # rows of docs with one key; those of one length are one row here, as they are to whoever counts by both
            new = np.append(0, np.cumsum(pc.fill_null(pc.not_equal(same[1:], same[:-1]), True).to_numpy(zero_copy_only=False)))
            by_key[sorted_keys] = new
            word, doc, tf, begin, pos = _merged(word, doc, tf, begin, pos, by_key, lengths)
        by = np.argsort(word * len(keys) + by_key[doc], kind="stable")
        word, doc, tf, begin = word[by], doc[by], tf[by], begin[by]
        for a in range(0, len(by), OUT_ROWS):
            w, d, n = word[a : a + OUT_ROWS], doc[a : a + OUT_ROWS], tf[a : a + OUT_ROWS]
            ends = np.append(0, np.cumsum(n))
            at = np.arange(ends[-1]) + np.repeat(begin[a : a + OUT_ROWS] - ends[:-1], n)
            bucket = bucket_of[w]
            cols = [words.take(pa.array(w)), keys.take(pa.array(d)), pa.array(n), pa.array(lengths[d]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[at])), pa.array(bucket, mask=bucket < 0)]
            yield pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(cols, schema, strict=True)], schema=schema)

    return run
