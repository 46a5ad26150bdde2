"""Set-oriented operators over versioned key-value data."""
