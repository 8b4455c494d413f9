"""Plans of several operators: the relocation of catalogs and of single events."""
