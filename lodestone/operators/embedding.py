"""Vectors from a provider: a service, or a function here, that embeds some texts at a time.

A provider takes a list of texts and answers with (index, vector) pairs in
whatever order. Tasks gather texts over their Arrow batches into calls of the
provider's size, put the answers in order by index, try again after a failure
and keep to the provider's rate; a call that fails for good fails the query.
"""

from __future__ import annotations

import json
import math
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.operators.vector import DIMENSIONS, embed_text
from lodestone.session import importable

Answer = list[tuple[int, list[float]]]


class ProviderError(Exception):
    """A call that cannot be mended by another try."""


@dataclass(frozen=True)
class Provider:
    """What embeds: `call` takes texts and gives (index, vector) pairs; `pause` is the least number of seconds between a task's calls."""

    call: Callable[[list[str]], Answer]
    dimensions: int = DIMENSIONS
    model: str = "hashed-words"
    batch: int = 100
    pause: float = 0.0
    tries: int = 4
    first_wait: float = 0.5


def hashed(dimensions: int = DIMENSIONS) -> Provider:
    """The local embedder: the same text gives the same vector everywhere."""
    return Provider(lambda texts: [(i, embed_text(x, dimensions).tolist()) for i, x in enumerate(texts)], dimensions)


@dataclass(frozen=True)
class Json:
    """A call of a service that takes and gives JSON over HTTP.

    body: what is sent, from the model and the texts; rows: the path to the
    list of answers in what comes back; vector and index: their fields in an
    answer. Without an index field answers are in the order of the texts.
    """

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    body: Callable[[str, list[str]], dict] = lambda model, texts: {"model": model, "input": texts}
    rows: tuple[str, ...] = ("data",)
    vector: str | None = "embedding"
    index: str | None = "index"
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> Answer:
        sent = json.dumps(self.body(self.model, texts)).encode()
        request = urllib.request.Request(self.url, sent, {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            found = json.load(response)
        for name in self.rows:
            found = found[name]
        return [(x[self.index] if self.index else i, x[self.vector] if self.vector else x) for i, x in enumerate(found)]


# The model each known service uses unless told otherwise, and its dimensions.
MODELS = {
    "openai": ("text-embedding-3-small", 1536),
    "google": ("text-embedding-004", 768),
    "voyage": ("voyage-3", 1024),
    "cohere": ("embed-english-v3.0", 1024),
}


def service(name: str, url: str, key: str, model: str | None = None, dimensions: int | None = None, **settings: object) -> Provider:
    """A provider for one of the known kinds of service at `url`; the key goes into the request's headers.

    openai and voyage answer with a list of indexed vectors, cohere with the
    vectors in order, google takes requests, not texts, and answers in order.
    """
    if name not in MODELS:
        raise ValueError(f"no provider is named {name}; there are {', '.join(MODELS)}")
    own, size = MODELS[name]
    model, bearer = model or own, {"Authorization": f"Bearer {key}"}
    if name == "cohere":
        call = Json(url, model, bearer, lambda m, texts: {"model": m, "texts": texts, "input_type": "search_document", "embedding_types": ["float"]}, ("embeddings", "float"), None, None)
    elif name == "google":
        one = lambda m, text: {"model": f"models/{m}", "content": {"parts": [{"text": text}]}}
        call = Json(url, model, {"x-goog-api-key": key}, lambda m, texts: {"requests": [one(m, x) for x in texts]}, ("embeddings",), "values", None)
    else:
        call = Json(url, model, bearer)
    return Provider(call, dimensions or size, model, **settings)


class Caller:
    """A task's way to a provider: calls are paced, tried again, checked and put in order."""

    def __init__(self, provider: Provider, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.provider, self.sleep, self.clock = provider, sleep, clock
        self._next = -math.inf

    def __call__(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.provider.tries + 1):
            if (wait := self._next - self.clock()) > 0:
                self.sleep(wait)
            self._next = self.clock() + self.provider.pause
            try:
                return self._ordered(self.provider.call(list(texts)), len(texts))
            except ProviderError:
                raise
            except Exception as error:
                if attempt == self.provider.tries:
                    raise RuntimeError(f"{self.provider.model}: {len(texts)} texts were not embedded after {attempt} tries: {error}") from error
                self.sleep(self.provider.first_wait * 2 ** (attempt - 1))
        raise ValueError("a provider needs at least one try")

    def _ordered(self, answer: Answer, n: int) -> list[list[float]]:
        found = dict(answer)
        if len(answer) != n or found.keys() != set(range(n)):
            raise ValueError(f"{len(answer)} answers for {n} texts, or an index that is not among them")
        wrong = {len(v) for v in found.values()} - {self.provider.dimensions}
        if wrong:
            raise ProviderError(f"{self.provider.model} gives vectors of {sorted(wrong)} dimensions, not {self.provider.dimensions}")
        return [found[i] for i in range(n)]


def embed(df: DataFrame, provider: Provider, text_col: str = "embedding_text", out: str = "embedding") -> DataFrame:
    """df with the provider's vector of a text column; null texts have none and are not sent.

    Rows keep their order within a task. Empty texts are sent like any other.
    A call holds texts of several Arrow batches if those are smaller, so only
    a task's last call is short. A column named `out` is replaced.
    """
    importable(df.sparkSession)
    rest = df.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, names = Caller(provider), [f.name for f in schema]
        held: list[pa.RecordBatch] = []
        waiting = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column(text_col).to_pylist()
            own = [i for i, x in enumerate(texts) if x is not None]
            ready = own if last else own[: len(own) // provider.batch * provider.batch]
            vectors: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(ready), provider.batch):
                some = ready[at : at + provider.batch]
                for i, v in zip(some, call([texts[i] for i in some]), strict=True):
                    vectors[i] = v
            # What goes on now ends before the first text that still waits.
            end = len(texts) if len(ready) == len(own) else own[len(ready)]
            done = table.slice(0, end).append_column(out, pa.array(vectors[:end], pa.list_(pa.float32())))
            yield from done.select(names).to_batches()
            held, waiting = table.slice(end).to_batches(), len(own) - len(ready)

        for batch in batches:
            held.append(batch)
            waiting += len(batch) - batch.column(text_col).null_count
            if waiting >= provider.batch:
                yield from flush(False)
        if held:
            yield from flush(True)

    return rest.mapInArrow(run, schema)


def embed_query(text: str, provider: Provider) -> list[float]:
    """The vector of one text, for a search."""
    return Caller(provider)([text])[0]

