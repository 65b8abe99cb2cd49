"""Operators that prepare documents and conversations for model training."""
