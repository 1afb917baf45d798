"""Plans, companions, reports and the sink."""
