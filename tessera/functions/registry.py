"""SQL names for the functions of this package."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx


def register(spark: SparkSession, tokenizer=None) -> list[str]:
    """fold_ws, strip_ctrl, dedup_key, unicode_norm, is_repetitive, chunk_tokens (table function), and bpe_encode and bpe_decode if a tokenizer is given."""
    ws = tx.WS.replace("\\", "\\\\")
    control = tx.CONTROL.replace("\\", "\\\\")
    lines = "array_sort(split(t, '\\\\n'))"
    run = "aggregate({}, named_struct('last', cast(null as string), 'run', 0, 'most', 0), (a, x) -> named_struct('last', x, 'run', if(a.last = x, a.run + 1, 1), 'most', greatest(a.most, if(a.last = x, a.run + 1, 1))), a -> a.most)".format(lines)
    # SQL functions are inlined by Catalyst
    for name, parameters, kind, body in [
        ("fold_ws", "t string", "string", f"trim(regexp_replace(t, '{ws}+', ' '))"),
        ("strip_ctrl", "t string", "string", f"regexp_replace(t, '{control}', '')"),
        ("dedup_key", "t string", "string", f"sha2(encode(trim(regexp_replace(t, '{ws}+', ' ')), 'UTF-8'), 256)"),
        ("is_repetitive", "t string", "boolean", f"size({lines}) >= 10 and {run} / size({lines}) >= 0.5"),
    ]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("string")
    def unicode_norm(text: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x if f == "none" or x.isascii() else unicodedata.normalize(f, x) for x, f in zip(text, form, strict=True)])

    spark.udf.register("unicode_norm", unicode_norm)

    @F.udtf(returnType="chunk int, input_ids array<int>")
    class ChunkTokens:
        def eval(self, ids, context_length: int):
            size = context_length + 1
            for k in range(len(ids or []) // size):
                yield k, list(ids[k * size : (k + 1) * size])

    spark.udtf.register("chunk_tokens", ChunkTokens)
    names = ["fold_ws", "strip_ctrl", "dedup_key", "is_repetitive", "unicode_norm", "chunk_tokens"]
    if tokenizer is not None:
        sent = spark.sparkContext.broadcast(tokenizer)

        @F.pandas_udf("array<int>")
        def bpe_encode(text: pd.Series) -> pd.Series:
            return text.map(lambda x: None if x is None else sent.value.encode(x))

        @F.pandas_udf("string")
        def bpe_decode(ids: pd.Series) -> pd.Series:
            return ids.map(lambda x: None if x is None else sent.value.decode([int(i) for i in x]))

        spark.udf.register("bpe_encode", bpe_encode)
        spark.udf.register("bpe_decode", bpe_decode)
        names += ["bpe_encode", "bpe_decode"]
    return names
