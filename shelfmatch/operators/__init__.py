"""Table operators: exclusion, acceptance, cards, components, holdings, collapse, search and incremental import."""
