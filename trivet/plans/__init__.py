"""Whole jobs: dataset building, evaluation, benchmarking, distillation."""
