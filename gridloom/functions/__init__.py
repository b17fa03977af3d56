"""Column functions: parsing, cleaning, calendar features, grid physics."""
