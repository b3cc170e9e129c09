"""Token counts with a tokenizer of the tokenizers library, for budgets of chats and replies."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def token_count(path: str) -> Callable[[Column], Column]:
    """A function of text: its tokens by the vocabulary at `path`, which every executor must have; null counts as empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        t = _tokenizer(path)
        return pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], dtype="int64")

    return count


def chat_text(messages: Column, opening: str = "<|{role}|>\n", closing: str = "\n") -> Column:
    """The messages of a chat as one text by a template: an opening with the role, the content, a closing."""
    before, after = opening.split("{role}")
    parts = F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), F.coalesce(m["content"], F.lit("")), F.lit(closing)))
    return F.array_join(parts, "")


def within_tokens(text: Column, path: str, most: int = 1024) -> Column:
    return token_count(path)(text) <= most
