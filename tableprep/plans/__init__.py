"""Preparation plans: model, checks, defaults and execution."""
