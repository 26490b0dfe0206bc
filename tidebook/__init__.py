"""Limit-order-book analytics on Spark: event chains, depth, spreads, positions, matching and repair."""
