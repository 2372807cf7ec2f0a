"""Explicit schemas of the run tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, D, I, L, B = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType()

COMMAND_STRUCT = _schema(b1_pos=D, b1_time=D, b1_speed=D, b2_pos=D, b2_time=D, b2_speed=D)

RUNS = _schema(run_id=S, b1_pos=I, b1_time=D, b1_speed=D, b2_pos=I, b2_time=D, b2_speed=D,
               initial_power=D, final_power=D, peak_power=D)

RUNS_WITH_INIT = _schema(run_id=S, init_b1=I, init_b2=I, b1_pos=I, b1_time=D, b1_speed=D, b2_pos=I, b2_time=D,
                         b2_speed=D, initial_power=D, final_power=D, peak_power=D)

WINDOW_RUNS = _schema(run_name=S, win_range=S, boron_range=S, init_case=S, move_type=S, boron_ppm=D,
                      monitor_window=D, switch_time=D, b1_pos=I, b1_time=D, b1_speed=D, b2_pos=I, b2_time=D,
                      b2_speed=D, initial_power=D, final_power=D, peak_power=D)

KINETICS_RUNS = _schema(id=L, input_reactivity=D, input_duration=D, power_initial=D, T_fuel_initial=D,
                        T_cool_initial=D, power_final=D, T_fuel_final=D, T_cool_final=D, power_min=D)

RESULTS = _schema(
    case_id=L, model=S, init_b1=I, init_b2=I, target_initial=D, target_final=D, description=S,
    parsing_success=B, predicted_params=COMMAND_STRUCT, full_prediction=S, simulation_success=B,
    result_parsing_success=B, actual_initial=D, actual_final=D, actual_peak=D, final_error=D,
    validation_success_1=B, validation_success_2=B, validation_success_3=B, validation_success_5=B,
    validation_success_10=B, error=S, regime=S, Kp_used=D)

# read as text first: the inputs may hold anything
PREDICTIONS_TEXT = _schema(run_id=S, monitor_window=S, initial_power=S, final_power=S, full_text=S, b1_pos=S,
                           b1_time=S, b1_speed=S, b2_pos=S, b2_time=S, b2_speed=S, parsed=S)
