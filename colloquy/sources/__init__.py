"""Readers and writers: dialogues, predictions, entities, instances, logs, reports and result tables."""
