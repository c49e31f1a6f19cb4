"""Native column expressions and the fixed values they use."""
