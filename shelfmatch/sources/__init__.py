"""Reading and writing: listings, sheets, exclusion rules, collections and compact holdings."""
