"""From texts to a word graph with degree, component and community of each word."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from flockscan.operators.collocations import StopWords, collocations
from flockscan.operators.communities import communities
from flockscan.operators.components import connected_components, largest_component
from flockscan.operators.graph import degrees, graph_stats, with_attribute
from flockscan.storage import save


@dataclass
class WordGraph:
    """``nodes`` carries every measure; ``core`` is the largest component ``(nodes, edges)``."""

    edges: DataFrame
    nodes: DataFrame
    stats: DataFrame
    core: tuple[DataFrame, DataFrame]


def word_graph(
    docs: DataFrame,
    word_freq: int = 1,
    coloc_freq: int = 1,
    stop_words: StopWords = (),
    resolution: float = 1.0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> WordGraph:
    ranked, words = collocations(docs, word_freq, coloc_freq, stop_words, doc_id, text)
    edges = save(ranked, "word-edges").frame
    nodes = save(words, "word-nodes").frame
    labels = connected_components(edges, nodes)
    measured = with_attribute(nodes, degrees(edges, nodes))
    measured = with_attribute(measured, labels)
    measured = with_attribute(measured, communities(edges, nodes, resolution))
    measured = save(measured, "word-measures").frame
    core = largest_component(edges, measured.select("id", "component"))
    return WordGraph(edges, measured, graph_stats(edges, nodes), core)

