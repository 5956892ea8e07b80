"""Conversational multimodal analytics as lazy PySpark plans."""
