"""Connected components, with this subpackage's tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trivet import graph
from trivet.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, component`` for every node of ``a, b``; the component is its smallest node."""
    scratch = scratch or Scratch(links.sparkSession)
    return graph.components(links, scratch.cut, scratch.free)
