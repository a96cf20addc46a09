"""DataFrame operators over findings and what belongs to them."""
