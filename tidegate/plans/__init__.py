"""Ready-made plans over the standard tables: feeds and the registered queries."""
