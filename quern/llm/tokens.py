"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import ast
import base64
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import kernels as K

#: Folder and file of the vocabulary (ranks of a byte-level BPE), and its splitting pattern's module.
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(folder: str = FOLDER, file: str = FILE):
    import tiktoken

    tree = ast.parse((Path(folder) / "__init__.py").read_text())  # the vocabulary's own pattern, read as data
    pattern = next(ast.literal_eval(x.value) for x in tree.body if isinstance(x, ast.Assign) and x.targets[0].id == "PATTERN")
    with open(Path(folder) / file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, file: str = FILE) -> DataFrame:
    """(id, *keep, tokens): tokens of each whole text; null and empty texts have none."""
    base = df.select(C.column(df, id_col, "long").alias("id"), *[C.column(df, k, "string").alias(k) for k in keep], C.column(df, text, "string").alias("text"))
    base = C.spread(base)
    schema = pa.schema([("id", pa.int64()), *[(k, pa.string()) for k in keep], ("tokens", pa.int64())])

    def count(b: pa.RecordBatch):
        e = encoder(folder, file)
        n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
        yield K.table(schema, b.column("id"), *[b.column(k) for k in keep], n)

    return C.map_rows(base, ["text"], count, schema)

