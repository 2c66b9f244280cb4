"""Training-data operators; each module is one operator, ``entries`` holds their queries."""
