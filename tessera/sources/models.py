"""Models and keys from outside: claim extraction, embeddings, keyed query hashes."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIMS = "id long, span_id long, subject string, verb string, object string, polarity string, error string"
#: What each field of a claim must be; other fields are passed over.
_FIELDS: dict[str, Callable[[object], bool]] = {
    "subject": lambda v: isinstance(v, str),
    "verb": lambda v: isinstance(v, str),
    "object": lambda v: isinstance(v, str),
    "span_id": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "polarity": lambda v: v in ("positive", "negative"),
}


def valid_claims(answer: str, verbs: frozenset[str] | None = None) -> list[dict]:
    """The claims of a model's answer, a JSON object with an array ``claims``; else ValueError.

    A claim is an object with subject, verb, object, span_id and polarity. With ``verbs`` any
    other verb is refused too.
    """
    data = json.loads(answer)
    claims = data.get("claims") if isinstance(data, dict) else None
    if not isinstance(claims, list):
        raise ValueError("not an object with a list of claims")
    for c in claims:
        wrong = [f for f, fits in _FIELDS.items() if not isinstance(c, dict) or not fits(c.get(f))]
        if wrong or (verbs is not None and c["verb"] not in verbs):
            raise ValueError(f"a claim's fields are wrong: {', '.join(wrong) or 'verb'}")
    return claims


def model_claims(rows: DataFrame, model: Callable[[list[str]], list[str]], id_col: str = "id", text_col: str = "content", batch: int = 8, verbs: frozenset[str] | None = None) -> DataFrame:
    """Claims that ``model`` (texts to answers) finds, asked in batches; an answer that isn't
    valid gives one row with its error, so that a bad row never stops the others."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                for i, answer in zip(part["_id"], model(part["_text"].fillna("").tolist()), strict=True):
                    try:
                        out += [(int(i), c["span_id"], c["subject"], c["verb"], c["object"], c["polarity"], None) for c in valid_claims(answer, verbs)]
                    except (ValueError, KeyError, TypeError) as e:
                        out.append((int(i), None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CLAIMS.split(", ")]).astype({"span_id": "Int64"})

    return rows.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(each, CLAIMS)


def query_key(text: Column, secret: bytes) -> Column:
    """The first 16 bytes of the HMAC-SHA256 of a query: tells equal queries without keeping them."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hmac.new(secret, t.encode(), hashlib.sha256).digest()[:16], na_action="ignore")

    return run(text)


def shadow_rows(answers: DataFrame, secret: bytes) -> DataFrame:
    """(query_key, ids, latency_ms) to append to the comparison log, from (query, ids array, latency_ms)."""
    return answers.select(query_key(F.col("query"), secret).alias("query_key"), F.to_json("ids").alias("ids"), "latency_ms")
