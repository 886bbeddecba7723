"""Embedding units: a column expression or a batch call inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, as_completed, wait
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.vectors import hashed_embedding, tokens

# Rows in one request, and requests in flight, unless a provider takes other numbers.
BATCH_ROWS = 256
CONCURRENCY = 8
# Bytes of rows whose requests may be in flight in a task.
FLIGHT_BYTES = 64 << 20

OK, NO_VECTOR, SHORT, FAILED = "ok", "no_vector", "short_response", "failed"


class BatchTooLarge(Exception):
    """Raised by a provider that refuses a batch for its size."""


class Response(NamedTuple):
    """Vectors in input order (None for one that cannot be read), and tokens billed."""

    vectors: Sequence[Sequence[float] | None]
    n_tokens: int | None = None


class ColumnProvider(NamedTuple):
    """A provider that is an expression: (text column, kind) to vector and token count."""

    name: str
    vector: Callable[[Column, str], Column]
    n_tokens: Callable[[Column], Column]


class BatchProvider(NamedTuple):
    """A provider called with (texts, kind) for at most `max_batch` texts at a time.

    Up to `concurrency` calls of a task run at once, in threads; 1 keeps them in order.
    """

    name: str
    call: Callable[[list[str], str], Response]
    max_batch: int = BATCH_ROWS
    concurrency: int = CONCURRENCY


def hashed_provider(dim: int = 64) -> ColumnProvider:
    """Hashed bag of words: needs no service, the same for queries and documents."""
    return ColumnProvider(
        f"hashed{dim}",
        lambda text, kind: hashed_embedding(text, dim),
        lambda text: F.size(tokens(text)).cast("bigint"),
    )


def embed(
    df: DataFrame,
    provider: ColumnProvider | BatchProvider,
    kind: str = "document",
    text: str = "content",
) -> DataFrame:
    """Add `vector`, `n_tokens`, `status` and `error` to rows that have a text.

    A batch that fails gives its rows a status and leaves the others alone; only rows with
    status ok are for the index, the rest are tried again by the next sync. `n_tokens` of a
    batch stands on its first row.
    """
    if kind not in ("query", "document"):
        raise ValueError(f"kind must be 'query' or 'document', not {kind!r}")
    rows = df.where(F.col(text).isNotNull())
    if isinstance(provider, ColumnProvider):
        return (
            rows.withColumn("vector", provider.vector(F.col(text), kind))
            .withColumn("n_tokens", provider.n_tokens(F.col(text)))
            .withColumn("status", F.when(F.col("vector").isNull(), NO_VECTOR).otherwise(OK))
            .withColumn("error", F.lit(None).cast("string"))
        )
    schema = T.StructType(
        rows.schema.fields
        + [
            T.StructField("vector", T.ArrayType(T.FloatType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("status", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )
    added = pa.schema(
        [
            pa.field("vector", pa.list_(pa.field("element", pa.float32()))),
            pa.field("n_tokens", pa.int64()),
            pa.field("status", pa.string()),
            pa.field("error", pa.string()),
        ]
    )
    size = provider.max_batch

    def answered(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(part.schema.get_field_index(text)).to_pylist()
        result = list(embed_batch(provider.call, texts, kind))
        extra = [pa.array([r[i] for r in result], type=field.type) for i, field in enumerate(added)]
        return pa.RecordBatch.from_arrays(part.columns + extra, names=part.schema.names + added.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(at, size) for batch in batches for at in range(0, batch.num_rows, size))
        if provider.concurrency <= 1:
            yield from map(answered, parts)
        else:
            yield from _in_flight(answered, parts, provider.concurrency, FLIGHT_BYTES)

    return rows.mapInArrow(run, schema)


def _in_flight(
    call: Callable[[pa.RecordBatch], pa.RecordBatch], parts: Iterator[pa.RecordBatch], most: int, most_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Results of calls as they end, with up to `most` of them, and `most_bytes` of rows, at once."""
    held: dict[Future, int] = {}
    with ThreadPoolExecutor(most) as pool:
        for part in parts:
            size = part.nbytes
            while held and (len(held) >= most or sum(held.values()) + size > most_bytes):
                for done in wait(held, return_when=FIRST_COMPLETED).done:
                    del held[done]
                    yield done.result()
            held[pool.submit(call, part)] = size
        for done in as_completed(held):
            yield done.result()


def embed_batch(
    call: Callable[[list[str], str], Response], texts: list[str], kind: str
) -> Iterable[tuple]:
    """(vector, n_tokens, status, error) per text, in order; halves a refused batch."""
    try:
        response = call(texts, kind)
    except BatchTooLarge as refusal:
        if len(texts) > 1:
            middle = len(texts) // 2
            yield from embed_batch(call, texts[:middle], kind)
            yield from embed_batch(call, texts[middle:], kind)
        else:
            yield None, None, FAILED, str(refusal)
        return
    except Exception as error:  # noqa: BLE001 - whatever a service raises is a row status
        for _ in texts:
            yield None, None, FAILED, str(error)
        return
    for i in range(len(texts)):
        n_tokens = response.n_tokens if i == 0 else None
        if i >= len(response.vectors):
            yield None, n_tokens, SHORT, "fewer vectors than texts"
        elif response.vectors[i] is None:
            yield None, n_tokens, NO_VECTOR, None
        else:
            yield response.vectors[i], n_tokens, OK, None


def token_total(embedded: DataFrame) -> DataFrame:
    """Sum of the token counts; null when no row has one."""
    return embedded.agg(F.sum("n_tokens").alias("n_tokens"))
