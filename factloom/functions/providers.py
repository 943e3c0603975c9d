"""Extension points: token counters, embedders, rerankers, judges and extractors, with offline defaults."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def token_counter(count: Callable[[str], int]):
    """A column function from any counter of tokens."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(count).astype("int32")

    return run


def embedder(size: int = 64):
    """The offline default: hashed words, summed and scaled to length one."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            vector = np.zeros(size, np.float32)
            for word in text.lower().split():
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vector[int.from_bytes(digest[:4], "little") % size] += 1 if digest[4] & 1 else -1
            norm = float(np.linalg.norm(vector))
            out.append((vector / norm if norm else vector).tolist())
        return pd.Series(out)

    return run


@udtf(returnType="subject: string, predicate: string, object: string, start: int, end: int")
class ExtractClaims:
    """Claims of the forms "we use X", "do not use X", "X is implemented in path" with the span that shows each."""

    def eval(self, text: str):
        import re

        for predicate, pattern in (
            ("uses", r"(?i)\b(?:we|project|team)\s+(?:now\s+)?uses?\s+([\w.+#-]+)"),
            ("forbidden", r"(?i)\b(?:do not|must not|never)\s+use\s+([\w.+#-]+)"),
            ("implemented_in", r"(?i)\bimplemented in\s+([\w./-]+)"),
            ("prefers", r"(?i)\bprefers?\s+([\w.+#-]+)"),
        ):
            for match in re.finditer(pattern, text or ""):
                yield "project", predicate, match[1].lower().rstrip("."), match.start(), match.end()


def judge(frame_rule: Callable[[pd.DataFrame], pd.DataFrame], schema: str):
    """A relationship or consolidation judge over batches of eligible pairs, for mapInPandas."""

    def run(frames):
        for frame in frames:
            yield frame_rule(frame)

    return run, schema
