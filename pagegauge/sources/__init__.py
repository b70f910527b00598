"""Readers and writers for ground truth, predictions, OCR responses and results."""
