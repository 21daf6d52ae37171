"""Embedding and language models behind small interfaces. The offline embedding is a hashed bag of tokens; there is no offline language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T


class HashedEmbedding:
    """Unit vectors of signed token counts, each token in the dimension that its hash names. Built-in functions only."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def column(self, text: Column) -> Column:
        toks = T.tokens(text)
        place = lambda t: F.pmod(F.xxhash64(t), F.lit(self.dim))
        sign = lambda t: F.when(F.shiftright(F.xxhash64(t), 40) % 2 == 0, 1.0).otherwise(-1.0)
        marks = F.transform(toks, lambda t: F.struct(place(t).alias("i"), sign(t).alias("s")))
        from marginalia.functions.columns import let

        def vector(m: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda d: F.aggregate(F.filter(m, lambda x: x["i"] == d), F.lit(0.0), lambda a, x: a + x["s"]))

        def unit(v: Column) -> Column:
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
            return F.transform(v, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm).cast("float"))

        return let(let(marks, vector), unit)

    def __call__(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("embedding", self.column(F.col(text)))


class BatchEmbedding:
    """A client that embeds lists of texts (texts -> vectors), called in batches of `batch` from Arrow batches on the executors.

    Where a batch fails, its texts are sent one by one; those that fail alone have a null vector and the reason in the column error.
    """

    def __init__(self, make_client, batch: int = 96):
        self.make_client, self.batch = make_client, batch

    def __call__(self, rows: DataFrame, text: str = "text") -> DataFrame:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        make, size = self.make_client, self.batch

        def one(client, given: list[str]) -> list[tuple]:
            try:
                return [(list(map(float, v)), None) for v in client(given)]
            except Exception as e:
                if len(given) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                return [x for t in given for x in one(client, [t])]

        def embed(parts):
            client = make()
            for part in parts:
                out = []
                for at in range(0, len(part), size):
                    out += one(client, part.iloc[at : at + size].tolist())
                yield pd.DataFrame(out, columns=["embedding", "error"])

        from collections.abc import Iterator

        embed.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        out = rows.withColumn("_e", pandas_udf(embed, "embedding array<float>, error string")(F.col(text)))
        return out.select(*rows.columns, "_e.embedding", "_e.error")


class NoLanguageModel:
    def __call__(self, system: str, prompt: str, temperature: float = 0.1) -> str:
        raise NotImplementedError("no language model is configured; pass one to Engine")
