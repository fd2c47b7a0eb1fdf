"""Operators for preparing large-scale training text. Nothing else imports this."""
