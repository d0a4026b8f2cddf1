"""Find and rank dangerous places in large tables of geo-located crash records."""
