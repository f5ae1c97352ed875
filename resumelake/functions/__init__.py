"""Part of resumelake; see the package."""
