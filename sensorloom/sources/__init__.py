"""Messages, reading tables, rules and exports."""
