"""Readers and writers with fixed schemas."""

from __future__ import annotations

import ast
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import list_literal

#: Raw video rows as they are collected; lists and flags arrive as text.
SILVER = """
video_id string, canal_id string, canal_nome string, nicho string, data_publicacao string, categoria_id string,
idioma_audio_default string, idioma_texto_default string, visualizacoes long, curtidas long, comentarios long,
duracao_segundos double, tem_legenda_nativa string, conteudo_licenciado string, feito_para_criancas string,
titulo string, descricao string, tags string, topicos_wikipedia string, texto_falado string, texto_thumbnail string,
descricao_visual_thumb string, score_viral double, label_viral string, velocidade_views double, taxa_conversao double,
taxa_discussao double, faixa_duracao string, dia_postagem string, janela_postagem string, hora_postagem int, idade_dias int
"""
FLAGS = ("tem_legenda_nativa", "conteudo_licenciado", "feito_para_criancas")
LISTS = ("tags", "topicos_wikipedia", "palavras_chave_shorttail", "palavras_chave_midtail", "palavras_chave_longtail", "ngramas_roteiro")
#: Nested literals of the derived columns: pairs, places of emoji, shares.
NESTED = {
    "coocorrencias_roteiro": "array<array<string>>", "titulo_emojis_posicao": "array<struct<emoji:string,posicao:string>>",
    "palavras_chave_proporcao": "struct<shorttail:double,midtail:double,longtail:double>",
}
#: Numbers and flags that a CSV may hold as text.
NUMBERS, DERIVED_FLAGS = ("descricao_cta_score",), ("tem_dialogo",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_silver_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, multi-line CSV with a header; rows that don't fit the schema keep nulls."""
    return spark.read.schema(SILVER).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def literal_json(c: Column) -> Column:
    """A Python literal (lists, tuples, dicts, texts with quotes and escapes) as JSON; what is none is null."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None or not text.strip() else json.dumps(ast.literal_eval(text.strip()), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one, na_action="ignore").astype(object)

    return convert(c)


def typed(df: DataFrame) -> DataFrame:
    """Flags as booleans, list literals as arrays, the publication time as a timestamp; blank text is null."""
    flag = lambda c: F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)
    out = df.withColumns({c: flag(F.col(c).cast("string")) for c in FLAGS if c in df.columns})
    out = out.withColumns({c: list_literal(F.col(c)) for c in LISTS if c in df.columns and dict(df.dtypes)[c] == "string"})
    out = out.withColumns({c: F.from_json(literal_json(F.col(c)), kind) for c, kind in NESTED.items() if c in df.columns and dict(df.dtypes)[c] == "string"})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in NUMBERS if c in df.columns})
    out = out.withColumns({c: F.lower(F.trim(F.col(c).cast("string"))) == "true" for c in DERIVED_FLAGS if c in df.columns})
    if "data_publicacao" in df.columns:
        out = out.withColumn("data_publicacao", F.try_to_timestamp("data_publicacao"))
    texts = [c for c in ("titulo", "descricao", "texto_falado", "texto_thumbnail", "descricao_visual_thumb") if c in df.columns]
    return out.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in texts})


def write_gold(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("nicho").parquet(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_patterns(df: DataFrame, path: str) -> None:
    """One JSON document per niche, in a folder of its own."""
    df.write.mode("overwrite").partitionBy("nicho").json(path)


def read_pattern(spark: SparkSession, path: str, niche: str) -> DataFrame:
    """The document of a niche, whose name is looked up in lower case."""
    return spark.read.json(path).where(F.col("nicho") == niche.lower())


def write_index(df: DataFrame, path: str) -> None:
    df.select("nicho", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, niches: Sequence[str] | None = None) -> DataFrame:
    """(nicho, embedding) of the index, of ``niches`` only if given; the filter reaches the files."""
    index = spark.read.schema("nicho string, embedding array<double>").parquet(path)
    return index if niches is None else index.where(F.col("nicho").isin(*niches))


def read_jdbc(spark: SparkSession, url: str, name: str, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """A table of the relational store; filters and columns are pushed down by Spark.

    ``split`` is (column, low, high, n): n tasks read ranges of a numeric, date or timestamp column; rows outside low .. high are in the
    first and last range. Without it one task reads the table.
    """
    if split:
        column, low, high, n = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
