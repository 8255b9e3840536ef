"""Query registry and registered queries."""
