"""Registered plans: one query and, where SQL can say it, one oracle per operator."""
