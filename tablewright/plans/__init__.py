"""Fitted cleaning plans and the bundled statistics report."""
