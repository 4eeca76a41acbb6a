"""Stages composed of operators, and the pipelines over them."""
