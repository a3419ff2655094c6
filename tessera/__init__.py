"""Thematic analytics over sentence corpora, expressed as Spark plans over explicitly keyed relations."""

__version__ = "0.1.0"
