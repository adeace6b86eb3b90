"""Rule-based extraction from texts: craft, names, statements and the relations they make."""
