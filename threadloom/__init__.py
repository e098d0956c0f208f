"""Threadloom: Spark-first analytics for support-conversation text.

``load`` reads a table of a data directory; ``functions`` holds column expressions, ``operators`` the
operators on frames, ``sources`` readers and writers, ``streaming`` the streaming forms.
"""

from threadloom.functions import text, times
from threadloom.operators import classify, metrics, pairing, ranking, retrieval, rules, sampling
from threadloom.session import Scratch, load
from threadloom.sources import files
from threadloom.streaming import ingest

__version__ = "0.2.0"
__all__ = ["Scratch", "classify", "files", "ingest", "load", "metrics", "pairing", "ranking", "retrieval", "rules", "sampling", "text", "times"]
