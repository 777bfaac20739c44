"""Loomsift: text distillation and analytics on Spark DataFrames."""
