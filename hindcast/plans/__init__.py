"""Plan building blocks shared by operators, and the registered queries."""
