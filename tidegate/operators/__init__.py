"""DataFrame operators: decode, drift, route, repair, deliver, observe, load."""
