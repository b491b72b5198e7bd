"""Stage plans, registered queries and their SQL oracles."""
