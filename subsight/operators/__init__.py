"""Set-based operators over the subscription tables."""
