"""Column functions: identifiers, paths, links, text, language tags, media types, numbers."""
