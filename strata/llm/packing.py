"""Documents packed into containers of fixed capacity, sizes in tokens of a public tokenizer.

Best-two-fit: a container is filled greedily with the largest documents that still fit;
then its smallest document gives way to two unpacked ones that together fill the gap it
leaves more tightly. A document is split only when it alone exceeds the capacity. Pieces
are spread by hash over groups of about ``group_pieces``, each packed by one task, so no
task ever holds more, and a group leaves at most about one container partly filled.
"""

from __future__ import annotations

import base64
import math
import os
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TOKENIZER = os.environ.get("STRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-splitting pattern that goes with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a ranks file, loaded once in a process."""
    got = _LOADED.get(path)
    if got is None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = got = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return got


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``key`` and the number of tokens of each whole text; null and empty texts have 0."""
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "n": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    got = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(count, f"k {kind}, n bigint")
    return got.select(F.col("k").alias(key), F.col("n").alias("n_tokens"))


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item; every size is at most ``capacity``.

    Ties go to the earlier item. Items of size 0 lie in the first container.
    """
    stock: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        stock[sizes[i]].append(i)
    left = 0  # bit s is set while an item of size s is unpacked
    for s in stock:
        if s > 0:
            left |= 1 << s
    out = [0] * len(sizes)
    container = 0

    def largest(most: int) -> int:
        return (left & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(size: int) -> int:
        nonlocal left
        items = stock[size]
        item = items.pop()
        if not items:
            left &= ~(1 << size)
        return item

    while left:
        packed: list[tuple[int, int]] = []
        gap = capacity
        while (s := largest(gap)) > 0:
            packed.append((s, take(s)))
            gap -= s
        if gap and len(packed) > 1:
            small, item = packed[-1]
            room, best, pair = gap + small, small, None
            a = largest(room - 1)
            while a > 0 and 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(stock[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                packed.pop()
                stock[small].append(item)
                left |= 1 << small
                packed += [(x, take(x)) for x in pair]
        for _, i in packed:
            out[i] = container
        container += 1
    return out


def pack(sizes: DataFrame, key: str, capacities: list[tuple[str, int]], group_pieces: int = 20_000) -> DataFrame:
    """(pack_name, key, piece, first_token, n_tokens, container) for each capacity; pieces count from 1.

    ``sizes`` has ``key`` and ``n_tokens``. Capacities that are null or below 1 pack
    nothing. Repeated keys are packed as often as they occur; an empty table packs nothing.
    """
    wanted = [(n, int(c)) for n, c in capacities if n is not None and c is not None and c > 0]
    kind = dict(sizes.dtypes)[key]
    schema = f"pack_name string, {key} {kind}, piece int, first_token bigint, n_tokens bigint, container bigint"
    if not wanted:
        return sizes.sparkSession.createDataFrame([], schema)
    totals = sizes.agg(*[F.sum(F.greatest(F.ceil(F.col("n_tokens") / c), F.lit(1))).alias(f"p{i}") for i, (_, c) in enumerate(wanted)]).first()
    packs = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity"), F.lit(max(1, math.ceil((totals[i] or 0) / group_pieces))).alias("groups")) for i, (n, c) in enumerate(wanted)])
    pieces = (
        sizes.select(F.col(key), "n_tokens", F.explode(packs).alias("p"))
        .select(key, "n_tokens", "p.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)).cast("int"))))
        .withColumn("first_token", (F.col("piece") - 1).cast("bigint") * F.col("capacity"))
        .withColumn("size", F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("first_token")))
        .withColumn("g", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.col("groups")))
        .select("pack_name", "capacity", "groups", "g", F.col(key).alias("k"), "piece", "first_token", "size")
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            capacity, groups, g = int(part["capacity"].iat[0]), int(part["groups"].iat[0]), int(part["g"].iat[0])
            local = best_two_fit(part["size"].tolist(), capacity)
            out = part[["pack_name", "k", "piece", "first_token", "size"]].copy()
            out["container"] = [c * groups + g for c in local]
            return out

        for pdf in batches:
            for where, part in pdf.groupby(["pack_name", "g"], sort=False):
                if where != now:
                    if held:
                        yield done()
                    now, held = where, []
                held.append(part)
        if held:
            yield done()

    out = pieces.repartition("pack_name", "g").sortWithinPartitions("pack_name", "g", F.desc("size"), "k", "piece")
    out = out.mapInPandas(fill, f"pack_name string, k {kind}, piece int, first_token bigint, size bigint, container bigint")
    return out.select("pack_name", F.col("k").alias(key), "piece", "first_token", F.col("size").alias("n_tokens"), "container")


def pack_documents(docs: DataFrame, key: str, text: str, capacities: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Packs whole documents into each capacity of ``capacities`` (pack_name, capacity_tokens); texts are tokenised once."""
    wanted = [(r[0], r[1]) for r in capacities.select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").toLocalIterator()]
    return pack(written(token_counts(docs, key, text, path), "p7-sizes"), key, wanted)
