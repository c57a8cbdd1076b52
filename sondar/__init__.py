"""sondar: a PySpark-native engine for labelled dialogues, token masks, ragged
activation sequences, probes and metrics, and for cleaning large text corpora."""

__version__ = "0.1.0"
