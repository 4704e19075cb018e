"""Query plans over the shared tables: adapter views, registered queries and their SQL counterparts."""
