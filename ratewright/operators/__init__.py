"""Operators over filing frames: projections, screens, grouped rates, peers, stability, panels, influence, object graph."""
