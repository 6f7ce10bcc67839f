"""DataFrame operators: pricing, heat, matching, alternates, risk, evaluation."""
