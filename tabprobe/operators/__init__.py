"""DataFrame operators: profile, clean, eda, query, charts, digest."""
