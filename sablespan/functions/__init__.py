"""Column functions: text normal forms, rule tables and validators."""
