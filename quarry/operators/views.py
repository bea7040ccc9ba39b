"""Views: how a document is shown. A view of one's own needs render_html only."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import documents


class View:
    """Text passes through; of other content there is a notice."""

    def render_html(self, markup: str) -> str:
        raise NotImplementedError

    def render_text(self, content: str) -> str:
        return content

    def render_binary(self, name: str) -> str:
        return f"[binary document: {name}]"


class Renders(Protocol):
    def render_html(self, markup: str) -> str: ...


class MarkdownView(View):
    def render_html(self, markup: str) -> str:
        return documents.markdown(markup)


class EmbeddingView(View):
    def render_html(self, markup: str) -> str:
        return documents.prose(markup)


def shown(name: Column, content: Column, view: View) -> Column:
    """The content of a document by its name, as the view renders it."""

    @F.pandas_udf("string")
    def run(names: pd.Series, kinds: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for n, k, c in zip(names, kinds, contents, strict=True):
            out.append(view.render_binary(n) if k == "binary" else None if c is None else view.render_html(c) if k == "html" else view.render_text(c))
        return pd.Series(out, dtype=object)

    kind = F.when(text.is_binary(name), "binary").when(text.is_html(name), "html").when(text.is_text(name), "text").otherwise("binary")
    return run(name, kind, content)
