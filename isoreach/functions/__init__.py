"""Column functions of the domain: geometry, tags, speeds, identifiers, dates."""
